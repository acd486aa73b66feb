"""Texts cut off by field limits or in transfer.

Two kinds of evidence are combined for each text that does not end in a complete sentence.

Length: per source (and kind of cut mark), and per source and year, every length is a candidate limit.
A log-normal law is fitted by maximum likelihood, right-censored at the candidate, and the candidate is a
limit if far more different texts stop there than the law, or the lengths around it, allow. The
censoring posterior of a text at its limit is the share of texts there that the law does not explain.
Texts elsewhere have the source's rate of transfer cuts as prior, learned by expectation-maximisation.

Ending: how likely the text's last words are where a cut falls on any character, against how likely
they are where a sentence ends. Both come from counts over all texts: words, word pairs, word
beginnings, and for rare words the endings of whole words against the endings of their beginnings.

Every text is tokenised once; the tokens are written to the shared folder and counted from there.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import written

#: A word is common if it makes up this share of all words, so there are at most 1 / COMMON common words.
COMMON = 2e-5
#: A word pair is kept if it makes up this share, so at most 1 / PAIRS pairs reach the driver.
PAIRS = 3e-6

#: What a cut leaves at the end.
_MARK = regex.compile(r"\s*(?:(?P<dots>\[?\s?\.\.\.\s?\]?|\[?…\]?)|(?P<broken>�+|&#?\w{0,7}))$")
_COMPLETE = regex.compile(r"""[.!?。！？؟।॥。…][\s"'”’»›“)\]」』）】]*$""")
_CLOSED = regex.compile(r"""[)\]"'”’»」』）]$""")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*|[,;:(]")
_END = regex.compile(r"""[.!?。！？؟।]["'”’»)\]]*(?=\s|$)""")
_PIECE = regex.compile(f"{_TOKEN.pattern}|{_END.pattern}")
_STOPS = ".!?。！？؟।"
_SIGNS = ",;:("
_OPEN, _CLOSE = "([{«“„「『（", ")]}»””」』）"


def split_mark(text: str) -> tuple[str, str]:
    """A text without trailing blanks and cut mark, and the kind of mark: '', 'dots' or 'broken'."""
    t = text.rstrip()
    # A mark ends in dots, a bracket or a broken character, or holds an ampersand among its last nine characters.
    if not t.endswith(("...", "…", "]", "�")) and "&" not in t[-9:]:
        return t, ""
    m = _MARK.search(t)
    if not m:
        return t, ""
    return t[: m.start()].rstrip(), "dots" if m["dots"] else "broken"


def unclosed(text: str) -> bool:
    """Whether the last sentence opens a bracket or quotation that the text never closes."""
    if not any(ch in text for ch in _OPEN) and '"' not in text:
        return False
    ends = [m.end() for m in _END.finditer(text) if m.end() < len(text)]
    tail = text[ends[-1] :] if ends else text
    depth = 0
    for ch in tail:
        if ch in _OPEN:
            depth += 1
        elif ch in _CLOSE and depth:
            depth -= 1
    return depth > 0 or tail.count('"') % 2 == 1 and text.count('"') % 2 == 1


def _rare(word: str, caps: bool) -> str:
    return "<R>" if caps or not word[0].islower() else "<r>"


def _capitals(tokens: list[str]) -> bool:
    """Whether a text is written in capitals: more than 0.8 of its words that have a case are."""
    big, small = sum(map(str.isupper, tokens)), sum(map(str.islower, tokens))
    if big <= 0.8 * (big + small):
        return False
    return big > 0.8 * sum(w.lower() != w.upper() for w in tokens)


def _trigram(rare: str, word: str) -> str:
    return rare + ("^^" + word)[-3:]


READ = "id {id}, source string, year int, org string, text_key binary, mark string, complete boolean, length int, n_chars int, capitals boolean, tokens string, body string"


def _read(rows: DataFrame) -> DataFrame:
    """The one pass over the texts: mark, ending, length and tokens (joined by line feeds) of each; ``body``, the text without its mark, of incomplete ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text in batch.column(5).to_pylist():
                t, mark = split_mark(text)
                tokens = _PIECE.findall(t)
                complete = not mark and bool(_COMPLETE.search(t[-40:]) or _COMPLETE.search(t))
                length = len(t) if mark == "dots" else len(text.rstrip())
                got.append((mark, complete, length, len(t), _capitals(tokens), "\n".join(tokens), None if complete else t))
            mark, complete, length, n, capitals, tokens, body = zip(*got, strict=True) if got else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(mark, pa.string()), pa.array(complete, pa.bool_()), pa.array(length, pa.int32()), pa.array(n, pa.int32()), pa.array(capitals, pa.bool_()), pa.array(tokens, pa.string()), pa.array(body, pa.string())],
                names=[f.split(" ")[0] for f in READ.split(", ")],
            )

    shaped = rows.select("id", "source", "year", "org", F.unhex(F.md5("text")).alias("text_key"), "text")
    return shaped.mapInArrow(run, READ.format(id=rows.schema["id"].dataType.simpleString()))


def _tokens(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each token's spelling, the spellings, where each text's tokens start)."""
    parts = pc.split_pattern(column, "\n")
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()
    chars = 0
    for batch in batches:
        chars += pc.sum(batch.column(0)).as_py() or 0
        index, words, _ = _tokens(batch.column(1))
        for w, k in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
            if w and w[0] not in _STOPS:
                n[w.lower()] += k
    n["<chars>"] = chars
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])


class Endings:
    """Counts of words, pairs and beginnings, and the evidence of an ending."""

    def __init__(self, common: frozenset[str], chars: int, counts: dict[tuple[str, str, str], int]):
        self.common, self.chars = common, max(1, chars)
        self.all, self.end, self.last = defaultdict(int), defaultdict(int), defaultdict(int)
        self.word_all, self.word_end, self.whole, self.part = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
        pairs = {"all": self.all, "end": self.end, "last": self.last}
        words = {"whole": self.whole, "part": self.part, "word_all": self.word_all, "word_end": self.word_end}
        for (kind, a, b), n in counts.items():
            if kind in pairs:
                pairs[kind][a, b] += n
            else:
                words[kind][b] += n
        self.n_end = max(1, sum(self.word_end.values()))
        self.n_last = max(1, sum(self.last.values()))
        self.rare_words: dict[str, int] = defaultdict(int)
        for tri, n in self.whole.items():
            self.rare_words[tri[:3]] += n
        self.starting: dict[str, list[str]] = defaultdict(list)
        for w in common:
            for k in range(1, len(w)):
                self.starting[w[:k]].append(w)
        self.memo: dict[tuple[str, str, str], float] = {}

    def evidence(self, a: str, word: str, rare: str) -> float:
        """Log odds of a cut against a sentence end after the words a, word; rare: the word's class if it is not common."""
        got = self.memo.get((a, word, rare))
        if got is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            got = self.memo[a, word, rare] = self._evidence(a, word, rare)
        return got

    def _evidence(self, a: str, word: str, rare: str) -> float:
        known = word in self.common
        b = word if known else rare
        tri, n_rare = _trigram(rare, word), self.rare_words[rare] + 20
        whole = 1.0 if known else (self.whole[tri] + 0.1) / n_rare
        part = (self.part[tri] + 0.1) / n_rare
        following = self.starting.get(word, ())
        begun = sum(self.all.get((a, w), 0) for w in following)
        seen, ended = self.all.get((a, b), 0), self.end.get((a, b), 0)
        pair = begun + self.all.get((a, rare), 0) * part
        # Words that texts end with far more often than cuts would make them: closing formulas without a mark.
        final = self.last.get((a, word), 0)
        chance = self.n_last * (2 * seen * whole + pair) / self.chars
        if seen < 5 and begun < 5:  # back off to the word alone
            seen, ended = self.word_all.get(b, 0), self.word_end.get(b, 0)
            pair = sum(self.word_all.get(w, 0) for w in following) + self.word_all.get(rare, 0) * part
        # A cut falls on one of all characters: after the word or its blank, or inside a longer word.
        cut = (2 * seen * whole + pair + 1e-3) / self.chars
        end = (ended + 1e-2) * whole / self.n_end
        if final > 3 + 5 * chance:
            end = max(end, final / self.n_last)
        return max(-12.0, min(12.0, math.log(cut / end)))

    def score(self, t: str, mark: str, caps: bool) -> float:
        """Evidence that an incomplete text t (without its mark) was cut."""
        if mark == "broken":
            return 12.0
        if _COMPLETE.search(t):  # a whole sentence before the mark
            return -6.0
        tokens = [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(t)]
        words = [x for x in tokens if x[0] not in _SIGNS]
        if not words:
            return -6.0
        open_ = unclosed(t)
        if _CLOSED.search(t) and not open_:
            return -5.0
        if words[-1][2] < len(t):  # a comma, dash or bracket follows the last word
            return 6.0
        at = tokens.index(words[-1])
        before = tokens[at - 1] if at else None
        a = "<s>"
        if before is not None and not _END.search(t[before[2] : words[-1][1]]):
            a = before[0] if before[0] in self.common or before[0] in _SIGNS else _rare(t[before[1] : before[2]], caps)
        found = self.evidence(a, words[-1][0], _rare(t[words[-1][1] : words[-1][2]], caps))
        if len(words) <= 3 and not mark:  # a placeholder rather than what a transfer left
            found = min(found, -4.0)
        return max(found, 4.0) if open_ else found


def _names(common: frozenset[str]) -> list[str]:
    """What the numbers in pair counts stand for: text start, signs, rare words, common words."""
    return ["<s>", *_SIGNS, "<R>", "<r>", *sorted(common)]


PAIR = "kind string, a int, b int, w string, n long"


def _pair_counts(common: frozenset[str]):
    names = _names(common)
    number = {w: k for k, w in enumerate(names)}
    rare, size = number["<R>"], len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, list[np.ndarray]] = {"all": [], "end": []}
        seen: Counter[tuple[str, bool]] = Counter()
        last: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            complete, mark, caps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            index, words, ends = _tokens(batch.column(0))
            lower = [w.lower() for w in words]
            # per spelling: its number, -1 for a rare word, -2 for an end mark, -3 for nothing
            code = np.array([-3 if not w else -2 if w[0] in _STOPS else number.get(x, -1) for w, x in zip(words, lower, strict=True)], np.int64)
            small = np.array([bool(w) and w[0].islower() for w in words])
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            c = code[index]
            c = np.where(c == -1, np.where(caps[text] | ~small[index], rare, rare + 1), c)
            first = np.r_[True, text[1:] != text[:-1]]
            a = np.where(first, 0, np.where(np.r_[0, c[:-1]] < 0, 0, np.r_[0, c[:-1]]))
            closes = np.r_[(c[1:] == -2) & ~first[1:], False]
            plain = c >= 0
            final = np.full(len(ends) - 1, -1)
            np.maximum.at(final, text[plain], np.flatnonzero(plain))
            is_word = (c == 0) | (c > len(_SIGNS))
            is_last = np.zeros(len(c), bool)
            is_last[final[final >= 0]] = True
            counted = is_word & (~is_last | complete[text])
            key = a * size + c
            pairs["all"].append(np.stack(np.unique(key[counted], return_counts=True)))
            pairs["end"].append(np.stack(np.unique(key[counted & closes], return_counts=True)))
            odd = counted & (code[index] == -1)
            for k, n in zip(*np.unique(index[odd] * 2 + (c[odd] == rare), return_counts=True), strict=True):
                seen[lower[k >> 1], bool(k & 1)] += int(n)
            for i in np.flatnonzero(is_word & is_last & ~complete[text] & (mark[text] != "broken")):
                last[int(a[i]), lower[index[i]]] += 1
        rows: list[tuple] = [("last", a, -1, w, n) for (a, w), n in last.items()]
        ends_in: Counter[tuple[str, str]] = Counter()
        for (w, big), n in seen.items():
            name = "<R>" if big else "<r>"
            ends_in["whole", _trigram(name, w)] += n
            for k in range(1, len(w)):
                ends_in["part", _trigram(name, w[:k])] += n
        rows += [(kind, -1, -1, w, n) for (kind, w), n in ends_in.items()]
        out = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)]
        fields = [f.split(" ")[0] for f in PAIR.split(", ")]
        yield pa.RecordBatch.from_arrays(out, names=fields)
        for kind, found in pairs.items():
            if found:
                every = np.concatenate(found, axis=1)
                keys, at = np.unique(every[0], return_inverse=True)
                n = np.bincount(at, every[1], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(keys), pa.string()), pa.array((keys // size).astype(np.int32)), pa.array((keys % size).astype(np.int32)), pa.array([""] * len(keys), pa.string()), pa.array(n)], names=fields
                )

    return run


def learn_endings(read: DataFrame) -> Endings:
    """The ending model of a table of read texts (see ``_read``). Only common words and pairs, whose number
    is bounded by COMMON and PAIRS, and word-end trigrams with a like share reach the driver."""
    counts = read.select("n_chars", "tokens").mapInArrow(_word_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = written(counts, "endings-words")
    chars = counts.filter("w = '<chars>'").agg(F.sum("n")).first()[0] or 0
    total = counts.filter("w != '<chars>'").agg(F.sum("n")).first()[0] or 0
    enough = (F.col("n") >= max(5, COMMON * total)) & ~F.col("w").isin("<chars>", *_SIGNS)
    common = frozenset(r["w"] for r in counts.filter(enough).select("w").collect())
    names = _names(common)
    pairs = read.select("tokens", "complete", "mark", "capitals").mapInArrow(_pair_counts(common), PAIR).groupBy("kind", "a", "b", "w").agg(F.sum("n").alias("n"))
    pairs = written(pairs, "endings-pairs")
    by_word = pairs.filter("kind in ('all', 'end')").groupBy("kind", "b").agg(F.sum("n").alias("n")).collect()
    kept = pairs.filter(F.col("n") >= F.when(F.col("kind").isin("all", "end"), max(2, PAIRS * total)).otherwise(max(1, PAIRS * total / 10))).collect()
    found = {(r["kind"], names[r["a"]] if r["a"] >= 0 else "", names[r["b"]] if r["b"] >= 0 else r["w"]): r["n"] for r in kept}
    return Endings(common, chars, found | {(f"word_{r['kind']}", "", names[r["b"]]): r["n"] for r in by_word})


def censored_fit(lengths: np.ndarray, counts: np.ndarray, limit: int, steps: int = 60) -> tuple[float, float]:
    """Mean and spread of log length by maximum likelihood (EM), lengths from limit - 1 on right-censored."""
    at = lengths >= limit - 1
    x, w = np.log(np.maximum(lengths[~at], 1)), counts[~at].astype(float)
    censored, n = float(counts[at].sum()), float(counts.sum())
    if not len(x):
        return math.log(max(limit, 1)), 0.5
    mu, sd = float(np.average(x, weights=w)), max(0.1, float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))))
    c = math.log(max(limit - 1, 1))
    for _ in range(steps):
        z = (c - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * hazard
        m2 = sd * sd * (1 + z * hazard - hazard * hazard) + m1 * m1
        new = (float(w @ x) + censored * m1) / n
        var = (float(w @ (x * x)) + censored * m2) / n - new * new
        mu, sd = new, math.sqrt(max(var, 1e-4))
    return mu, sd


def _poisson_tail(k: float, mean: float) -> float:
    """Log of an upper bound of P(X >= k) for a Poisson variable, k above the mean."""
    return k - mean - k * math.log(k / max(mean, 1e-9))


def _normal(v: float) -> float:
    return 0.5 * math.erfc(-v / math.sqrt(2))


class Lengths:
    """How many different texts have each length."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.lengths, at = np.unique(lengths, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.lengths))
        self.upto = np.r_[0, np.cumsum(self.counts)]
        self.n = float(self.upto[-1])

    def between(self, low: np.ndarray | float, high: np.ndarray | float):
        """Texts of length low to high."""
        return self.upto[np.searchsorted(self.lengths, high, "right")] - self.upto[np.searchsorted(self.lengths, low, "left")]

    def law(self, limit: int):
        """(expected texts at the limit or one below, hazard there) by the law censored at the limit."""
        mu, sd = censored_fit(self.lengths, self.counts, limit)
        cdf = lambda v: _normal((math.log(max(v, 0.5)) - mu) / sd)
        here = cdf(limit + 0.5) - cdf(limit - 1.5)
        return self.n * here, min(0.5, max(1e-4, here / max(1e-12, 1 - cdf(limit - 1.5))))

    def excess(self, level: float = 1e-4) -> dict[int, tuple[float, float]]:
        """{limit: (censoring posterior, hazard)}: lengths where far more texts stop (there or, after a blank, one below) than
        both the lengths around it and the censored law allow, whatever longer texts exist."""
        x = self.lengths.astype(float)
        here, beside = self.between(x - 1, x), np.maximum(self.between(x - 1, x - 1), self.between(x + 1, x + 1))
        ten = np.ceil(0.1 * x) + 2
        around = 2 * np.maximum(self.between(x - ten, x - 2), self.between(x + 1, x + ten)) / (ten - 1)
        out = {}
        for k in np.flatnonzero((self.counts >= beside) & (here >= 3) & (here > 4 * around + 2)):
            limit = int(self.lengths[k])
            by_law, hazard = self.law(limit)
            expected = max(by_law, around[k])
            if here[k] > 4 * expected + 2 and _poisson_tail(here[k], expected) < math.log(level / len(x)):
                out[limit] = (float(1 - min(1.0, expected / here[k])), hazard)
        return out


#: Share of a limited year's longer texts that may stand over the limit all the same (wrong years, later corrections).
STRAY = 0.01


def find_limits(rows: list[tuple]) -> dict[tuple, float]:
    """{(year, length): censoring posterior} of one source and mark, from rows (year, length, different texts).

    A limit is a length in excess in the source as a whole or in one of its years. A year in which a limit
    of the source is not in excess by itself has it if its texts at the limit, against its longer ones,
    are likelier under the limit than without. Undated texts (year None) have the mean posterior of the dated ones at that length, or
    the source's own without such. A limit covers its length and, for a blank at the cut, one less.
    """
    years: dict = defaultdict(list)
    for year, length, n in rows:
        years[year].append((length, n))
    sized = {y: Lengths(np.array([x for x, _ in v]), np.array([n for _, n in v])) for y, v in years.items()}
    whole = Lengths(np.array([x for _, x, _ in rows]), np.array([n for _, _, n in rows]))
    shared = whole.excess()
    dated = {y: s for y, s in sized.items() if y is not None}
    own = {y: s.excess() for y, s in dated.items()}
    found: dict[tuple, float] = {}
    for limit in sorted(set(shared).union(*own.values())):
        seen = mass = 0.0
        for y, s in dated.items():
            here, above = float(s.between(limit - 1, limit)), float(s.between(limit + 1, np.inf))
            p = 0.0
            if limit in own[y]:
                p = own[y][limit][0]
            elif limit in shared and here:
                hazard = shared[limit][1]
                odds = here * math.log((1 - STRAY) / hazard) + above * math.log(STRAY / (1 - hazard))
                p = (1 - hazard) / (1 + math.exp(-max(-40.0, min(40.0, odds))))
            if p > 0:
                found[y, limit] = p
            seen, mass = seen + here, mass + here * p
        if seen or limit in shared:
            found[None, limit] = mass / seen if seen else shared[limit][0]
    out: dict[tuple, float] = defaultdict(float)
    for (y, limit), p in found.items():
        for length in (limit - 1, limit):
            out[y, length] = max(out[y, length], p)
    return dict(out)


LIMITS = "source string, m string, year int, length int, at_limit double"


def limits(scored: DataFrame) -> DataFrame:
    """``source, m, year, length, at_limit``: the censoring posterior at each limit, per source, mark and year. Lengths are counted over
    different texts and exactly; a source's counts per year and length meet in one task, its rows do not."""
    sizes = scored.select("source", "m", "year", "length", "text_key").distinct().groupBy("source", "m", "year", "length").agg(F.count("*").alias("n"))

    def run(key, table):
        got = find_limits(list(zip(*(table.column(c).to_pylist() for c in ("year", "length", "n")), strict=True)))
        years, lengths = zip(*got, strict=True) if got else ((), ())
        same = lambda v: pa.array([v.as_py()] * len(got), pa.string())
        return pa.table({"source": same(key[0]), "m": same(key[1]), "year": pa.array(years, pa.int32()), "length": pa.array(lengths, pa.int32()), "at_limit": pa.array(list(got.values()), pa.float64())})

    return written(sizes.groupBy("source", "m").applyInArrow(run, LIMITS), "truncation-limits")


def _scores(read: DataFrame, model: Endings) -> DataFrame:
    """Incomplete texts of a read table with their ``evidence``."""
    broadcast = read.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in batches:
            body, mark, caps = (batch.column(c).to_pylist() for c in ("body", "mark", "capitals"))
            found = pa.array([m.score(*x) for x in zip(body, mark, caps, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], found], names=[*batch.schema.names[:-2], "evidence"])

    rows = read.filter("not complete").select("id", "source", "year", "org", "text_key", "mark", "m", "length", F.length("body").alias("n_body"), F.md5(F.lower("body")).alias("begins"), "body", "capitals")
    out = rows.drop("body", "capitals").withColumn("evidence", F.lit(0.0)).schema
    return rows.select(*[c for c in rows.columns if c not in ("body", "capitals")], "body", "capitals").mapInArrow(run, out)


def _continued(texts: DataFrame, incomplete: DataFrame) -> DataFrame:
    """``org, begins``: incomplete texts (md5 of their small letters) that another text of the same organization carries on past a word or sentence.

    ``texts``: ``org, text``; ``incomplete``: ``org, begins, n_body, start`` where ``start`` is the md5 of the first 2^k characters, the largest power of
    two in the text. Longer texts are looked up by their own beginnings of such lengths, so two texts meet only if
    they share more than half of the shorter one. Copies are one text on both sides.
    """
    orgs = incomplete.select("org").distinct()
    longer = texts.join(orgs, "org", "left_semi").select("org", F.lower("text").alias("more")).distinct()
    beginnings = F.expr("transform(sequence(0, cast(floor(log2(length(more))) as int)), k -> md5(substring(more, 1, cast(shiftleft(1, k) as int))))")
    keyed = longer.withColumn("start", F.explode(beginnings))
    hit = keyed.join(incomplete.distinct(), ["org", "start"]).filter("length(more) > n_body + 1 and md5(substring(more, 1, n_body)) = begins")
    return hit.filter(~F.expr("substring(more, n_body + 1)").rlike(r"^\s*[.!?]")).select("org", "begins").distinct()


def truncation(df: DataFrame, id_col: str, text_col: str, source_col: str, year_col: str, org_col: str) -> DataFrame:
    """``id, source, length, mark, complete, at_limit, evidence, p_cut, cut`` of every text that is not blank.

    ``cut`` is p_cut > 0.5. Null and blank texts have no row; a null source counts as one source;
    repeated rows are judged alike. Complete texts, which end as a sentence does, are never cut in the sense of this operator.
    """
    rows = df.filter(F.col(text_col).rlike(r"(?U)\S")).select(
        F.col(id_col).alias("id"), F.coalesce(source_col, F.lit("")).alias("source"), F.col(year_col).cast("int").alias("year"), F.col(text_col).alias("text"), F.col(org_col).alias("org")
    )
    read = written(_read(rows), "truncation-texts").withColumn("m", F.when(F.col("mark") == "broken", "").otherwise(F.col("mark")))
    model = learn_endings(read)
    year = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 31)))
    known = limits(read).select("source", "m", year("year").alias("y"), "length", "at_limit")
    limited = lambda x: x.withColumn("y", year("year")).join(known, ["source", "m", "y", "length"], "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(0.0)))
    start = F.expr("md5(substring(lower(body), 1, cast(shiftleft(1, cast(floor(log2(n_body)) as int)) as int)))")
    begun = read.filter("not complete and length(body) > 0 and org is not null").withColumn("n_body", F.length("body"))
    longer = _continued(rows.select("org", "text"), begun.select("org", F.md5(F.lower("body")).alias("begins"), "n_body", start.alias("start")))
    x = limited(_scores(read, model)).join(longer.withColumn("__goes_on", F.lit(True)), ["org", "begins"], "left")
    # A short text may begin a longer one by chance: this evidence grows with its length.
    carried = F.greatest("evidence", F.least(F.lit(10.0), (F.col("n_body") - 20) / 2))
    x = written(x.withColumn("evidence", F.when(F.col("__goes_on"), carried).otherwise(F.col("evidence"))).select("id", "source", "length", "mark", "at_limit", "evidence"), "truncation-evidence")
    rate = df.sparkSession.createDataFrame(list(_transfer_rates(x).items()), "source string, rate double")
    x = x.join(rate, "source", "left")
    before = F.greatest(F.coalesce("rate", F.lit(0.05)), F.least(F.col("at_limit"), F.lit(0.995)))
    p = 1 / (1 + F.exp(-(F.log(before / (1 - before)) + F.col("evidence"))))
    judged = x.select("id", "source", "length", "mark", F.lit(False).alias("complete"), "at_limit", "evidence", p.alias("p_cut"))
    whole = limited(read.filter("complete")).select("id", "source", "length", "mark", F.lit(True).alias("complete"), "at_limit", F.lit(-12.0).alias("evidence"), F.lit(0.0).alias("p_cut"))
    return judged.unionByName(whole).withColumn("cut", F.col("p_cut") > 0.5)


def _transfer_rates(x: DataFrame, rounds: int = 50) -> dict[str, float]:
    """Share of cuts among each source's incomplete texts below the limit, by EM over a histogram of the evidence."""
    bins = x.filter("at_limit < 0.5").groupBy("source", F.round("evidence", 1).alias("e")).agg(F.count("*").alias("n")).collect()
    by: dict[str, list[tuple[float, int]]] = defaultdict(list)
    for r in bins:
        by[r["source"]].append((r["e"], r["n"]))
    out = {}
    for source, found in by.items():
        e, n = np.array([v for v, _ in found]), np.array([v for _, v in found], float)
        rate = 0.3
        for _ in range(rounds):
            odds = rate / (1 - rate) * np.exp(e)
            rate = float(np.clip((float(n @ (odds / (1 + odds))) + 0.5) / (n.sum() + 2), 1e-3, 0.98))
        out[source] = rate
    return out


def report(found: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many of them stand at a limit or carry a mark."""
    return found.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("cut_share"),
        F.count_if(F.col("cut") & (F.col("at_limit") >= 0.5)).alias("n_at_limit"), F.count_if(F.col("cut") & (F.col("mark") != "")).alias("n_marked"),
    )
