"""Sentence units of texts in many languages and scripts.

Blank lines, list items and headings on lines of their own end units in any script; in Thai, blanks
that touch no digit and line breaks do too. Elsewhere every end mark (with the closing quotes and brackets
after it) is a candidate that a maximum-entropy classifier decides from its neighbouring tokens,
case, length, digits and script.

The classifier learns from reliable boundaries only. Counts over all texts say how often a token stands
before the mark at the end of a paragraph and how often elsewhere, and how often a token starts a
paragraph and how often it follows a mark elsewhere. Abbreviations never end paragraphs, and words that
carry a sentence on never start one, in any language. Weights are fitted to paragraph ends (boundaries), to marks
followed by a small letter, and to marks whose tokens never end or start a paragraph (none).

A heading before a single line break is told by its form (no end mark, words with capitals, and a next line
that starts as sentences do), of any length and however rare, or by standing as a paragraph of its own elsewhere.

The texts are read once: each text's candidates, with the tokens around them, are written to the shared folder.
Counting, fitting and deciding work on these columns, in whole arrays.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import written

#: A token is kept with its counts if it makes up this share of all sites, so at most 3 / KEPT rows reach the driver.
KEPT = 5e-6
#: About how many sites the weights are fitted to: the reliable ones of texts drawn by hash. All other steps use every text.
SAMPLE = 40_000

#: End marks, closing and opening signs, list markers.
_NL = r"(?:\r\n|[\n\r\x85  ])"
_PARAGRAPH = regex.compile(rf"(?:[^\S\r\n\x85  ]*{_NL}){{2,}}\s*")
_LINE = regex.compile(_NL)
_ITEM = regex.compile(r"[^\S\r\n]*(?:[-*•‣▪◦·–—]|\(?\p{Nd}{1,3}[.)]|\(?[A-Za-z]\)|[a-e]\.)[^\S\r\n]+(?=\S)")
_MARK = regex.compile(r"[.!?…。！？｡．؟।॥۔⁇⁈⁉‼]+")
_CLOSERS = "\"'”’»›」』）】)]“"
_OPENERS = "\"'“„«‹「『（【([¿¡"
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》"}
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_THAI = regex.compile(r"\p{Thai}")
_BLANKS = regex.compile(r"\s*")
_NEXT = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’&-]|\.(?=\p{L}))*")
_BACK = regex.compile(r"(?r)(?:[\p{L}\p{M}\p{N}'’&-]|\.(?=[\p{L}\p{N}]))*")
_ENDED = regex.compile(r"""[.!?…。！？｡؟।॥۔](?:\s?["'”’»›」』）】)\]“])*$""")


#: What a candidate is: an end mark, a sure boundary, an edge of a line that is a heading if it is known as one, a line break after what may be a heading by its form.
MARK, SURE, KNOWN, FORM = range(4)
#: Cases of the letter after a candidate, by number.
CASES = ("lower", "sign", "upper", "none", "digit", "end")
#: Joins the tokens of a text's candidates in one column.
SEP = "\x1f"


class Site(NamedTuple):
    """A candidate: where it ends, and what stands around it. ``context`` is the token before the mark, the mark and the closing
    signs, with line feeds between them; ``flags`` hold kind of mark, closing sign, case, opening sign, capitals, end of piece and title."""

    end: int
    context: str
    next: str
    pair: str
    flags: int

    @property
    def last(self) -> bool:
        return bool(self.flags >> 10 & 1)


def _token(word: str) -> str:
    """Small letters; numbers by their number of digits, as days and years stand in other places."""
    w = word.lower()
    if not w[0].isdigit() or not w.isdigit() and any(c.isalpha() for c in w):
        return w
    return f"<{min(len(w), 5)}>" if w.isdigit() else "<num>"


def _following(text: str, at: int, end: int) -> tuple[str, str, str, str]:
    """(first token, first two tokens, case of the first letter, opening sign) from a place on."""
    opener = ""
    while at < end and (text[at].isspace() or text[at] in _OPENERS):
        if text[at] in _OPENERS:
            opener = opener or text[at]
        at += 1
    if at >= end:
        return "", "", "end", opener
    if text[at] > "⺀" and _CJK.match(text[at]):
        return text[at : at + 2].replace(SEP, " "), text[at : at + 4].replace(SEP, " "), "none", opener
    m = _NEXT.match(text, at, end)
    if not m:
        return "", "", "sign", opener
    word, j = m.group(), m.end()
    # initials and one-letter abbreviations keep their case and their stop
    first = word + text[j : j + 1] if len(word) == 1 and word.isalpha() else _token(word)
    m2 = _NEXT.search(text, j, end)
    ch = word[0]
    case = "digit" if ch.isdigit() else "lower" if ch.islower() else "upper" if ch.isupper() or unicodedata.category(ch) == "Lt" else "none"
    return first, f"{first} {_token(m2.group())}" if m2 else first, case, opener


_SIGN = regex.compile("[" + regex.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + '"') + "]")


def _inside(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Outermost stretches inside brackets or quotations that are closed later: places after their openings, places of their closings."""
    found: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    for m in _SIGN.finditer(text, start, end):
        ch, i = m.group(), m.start()
        if waiting[ch]:
            while open_:
                closing, at = open_.pop()
                waiting[closing] -= 1
                if closing == ch:
                    found.append((at + 1, i))
                    break
        elif ch in _PAIRS or ch == '"':
            open_.append((_PAIRS.get(ch, ch), i))
            waiting[open_[-1][0]] += 1
    found.sort()
    begins: list[int] = []
    stops: list[int] = []
    for a, b in found:
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            begins.append(a)
            stops.append(b)
    return begins, stops


def _within(inside: tuple[list[int], list[int]], at: int) -> bool:
    if not inside[0]:
        return False
    k = bisect_right(inside[0], at) - 1
    return k >= 0 and at <= inside[1][k]


class Piece(NamedTuple):
    """A stretch that no unit crosses, blanks around it left out; ``body`` is where it starts after a list marker, ``lines`` its lines if there are several."""

    start: int
    body: int
    end: int
    lines: list[tuple[int, int]]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    return a, b


def pieces(text: str) -> list[Piece]:
    out: list[Piece] = []

    def put(lines: list[tuple[int, int]], item: int) -> None:
        a, b = _trim(text, lines[0][0], lines[-1][1])
        if a < b:
            out.append(Piece(a, max(a, item), b, lines if len(lines) > 1 and not item else []))

    at = 0
    breaks = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)] if _LINE.search(text) else []
    for stop, after in [*breaks, (len(text), len(text))]:
        lines, line = [], at
        for m in _LINE.finditer(text, at, stop):
            lines.append((line, m.start()))
            line = m.end()
        lines.append((line, stop))
        at = after
        open_: list[tuple[int, int]] = []
        marker = 0  # where the text of the open piece starts after its list marker
        for a, b in lines:
            item = _ITEM.match(text, a, b)
            if open_ and (item or marker and not text[a:b].lstrip()[:1].islower()):
                put(open_, marker)
                open_ = []
            if not open_:
                marker = item.end() if item else 0
            open_.append((a, b))
        put(open_, marker)
    return out


def _titled(line: str) -> bool:
    """Whether a line is written as titles are: its first word and all of four letters or more start with a capital."""
    words = _NEXT.findall(line)
    cased = [w for k, w in enumerate(words) if (k == 0 or len(w) > 3) and w[0].lower() != w[0].upper()]
    return bool(cased) and words[0] == cased[0] and all(w[0].isupper() for w in cased)


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) >> 1


def _unspaced(text: str, start: int, i: int, j: int) -> bool:
    """Whether a stop at text[i:j] with a letter or digit right after it may end a sentence whose blank is missing."""
    nxt = text[j]
    if nxt.isdigit() or nxt.islower():
        return False
    word = i - 3 >= start and text[i - 3 : i].isalnum()
    if nxt.isupper():
        if word and (text[j + 1 : j + 2].isspace() or text[j + 1 : j + 2] in ("'", "’")):  # a word of one letter, also a clipped one
            return True
        return text[j + 1 : j + 2].islower() and (text[i - 1].islower() or text[i - 1].isdigit()) or word and text[j + 1 : j + 2].isalpha()
    return word  # a script without case


def sites(text: str, span: tuple[int, int, int], following: int, stop: int) -> Iterator[Site]:
    """Candidates of a piece at end marks; ``following`` is where the text goes on after it, for the one at its end."""
    a, body, b = span[:3]
    inside = None
    before = a
    for m in _MARK.finditer(text, body, b):
        i, j = m.span()
        mark = text[i:j]
        if mark == "." and j < b and text[j].isalnum() and not _unspaced(text, a, i, j):
            continue
        # closing signs, also after the narrow blank of French
        k = j
        if inside is None:
            inside = _inside(text, a, b)
        while k < b:
            if text[k] in _CLOSERS and not (text[k] in "\"'“" and not _within(inside, k) and k + 1 < b and text[k + 1].isalnum()):
                if text[k] == '"' and not _within(inside, k):
                    break
                k += 1
            elif text[k] in "   " and text[k + 1 : k + 2] in ("»", "›") and k + 1 < b:
                k += 2
            else:
                break
        last = k >= b
        if not last:
            if _MARK.match(text, k) or _within(inside, k):  # another mark follows the closing signs; or the stretch goes on
                continue
            if not text[k].isspace() and text[k] not in _OPENERS and not (text[k] > "⺀" and _CJK.match(text[k])) and not (text[k].isalpha() and not text[k].islower()) and mark in (".", "..."):
                continue
        nxt, pair, case, opener = _following(text, following if last else k, stop if last else b)
        e = i
        while e > before and (text[e - 1].isspace() or text[e - 1] in "\"'”’»›」』）】)]"):
            e -= 1
        if e > before and text[e - 1] > "⺀" and _CJK.match(text[e - 1]):
            prev = text[max(before, e - 2) : e].lower().replace(SEP, " ").replace("\n", " ")
        else:
            prev = _BACK.match(text, before, e).group().lstrip("'’&-.")
            prev = _token(prev) if prev else ""
        closer = text[j:k].strip()
        kind = (3 if i > a and text[i - 1].isspace() else 2) if (len(mark) > 1 or mark == "…") and not mark.strip(".…") else 0 if mark in "..。｡।॥۔" else 1
        flags = kind | (0 if not closer else 1 if closer[-1] in ")]）】" else 2) << 2 | CASES.index(case) << 4 | (0 if not opener else 1 if opener in "¿¡" else 2) << 7
        if len(prev) > 2 and text[i - 1].isupper() and text[i - len(prev)].isupper():
            flags |= 1 << 9
        if last:
            flags |= 1 << 10
        yield Site(k, f"{prev}\n{mark}\n{closer}", nxt, pair, flags)
        before = k


class Look:
    """What one text gives: its candidates in order (end, where the text goes on, kind << 16 | flags, line), the tokens around
    them, the tokens that start its paragraphs, and its paragraphs of one line without an end mark."""

    def __init__(self, text: str):
        self.cuts: list[tuple[int, int, int, int]] = []
        self.contexts: list[str] = []
        self.nexts: list[str] = []
        self.pairs: list[str] = []
        self.starts: list[tuple[str, str]] = []
        self.alone: list[int] = []
        self.thai = not text.isascii() and bool(_THAI.search(text))
        found = pieces(text)
        self.first = found[0].start if found else -1
        for k, piece in enumerate(found):
            after = found[k + 1] if k + 1 < len(found) else None
            self._piece(text, piece, after)

    def _piece(self, text: str, piece: Piece, after: Piece | None) -> None:
        a, body, b, lines = piece
        resume = after.start if after else -1
        got: list[tuple] = []
        last = False
        for s in sites(text, piece, after.body if after else len(text), len(text)):
            on = s.end
            last = last or s.last
            if s.last:
                on = resume
            else:
                while text[on].isspace():
                    on += 1
            got.append((s.end, on, MARK << 16 | s.flags, 0, s.context, s.next, s.pair))
        if not last:
            got.append((b, resume, SURE << 16, 0, "", "", ""))
        if a == body:
            first, pair, _, _ = _following(text, a, b)
            if first:
                self.starts.append((first, pair))
            if not lines and not _ENDED.search(text, max(a, b - 40), b):
                self.alone.append(line_key(text[a:b]))
        sort = False
        if lines:
            sort = True
            got += self._lines(text, lines)
        if self.thai and _THAI.search(text, a, b):
            sort = True
            for m in regex.finditer(r"\s+", text, pos=body, endpos=b):
                left, right = text[m.start() - 1], text[m.end() : m.end() + 1]
                thai = bool(_THAI.match(left)) or bool(right and _THAI.match(right))
                if thai and (_LINE.search(m.group()) or not (left.isdigit() or right.isdigit())):
                    got.append((m.start(), m.end(), SURE << 16, 0, "", "", ""))
        if sort:
            got.sort(key=lambda c: c[0])
        for c in got:
            self.cuts.append(c[:4])
            self.contexts.append(c[4])
            self.nexts.append(c[5])
            self.pairs.append(c[6])

    def _lines(self, text: str, lines: list[tuple[int, int]]) -> Iterator[tuple]:
        """Candidates at the single line breaks of a piece: edges of lines that may be headings."""
        spans = [t for t in (_trim(text, a, b) for a, b in lines) if t[0] < t[1]]
        fresh = True
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            ended = bool(_ENDED.search(text, max(a, b - 40), b))
            small = text[c].islower()
            if not small:
                yield b, c, KNOWN << 16, line_key(text[a:b]), "", "", ""
                if fresh and not ended:
                    first, pair, case, _ = _following(text, c, d)
                    if case == "upper":
                        yield b, c, FORM << 16 | _titled(text[a:b]) << 11, 0, "", first, pair
            yield b, c, KNOWN << 16, line_key(text[c:d]), "", "", ""
            fresh = ended


LOOKED = "id {id}, h long, first int, cuts binary, contexts string, nexts string, pairs string, starts string, start_pairs string, alone binary"


def look(rows: DataFrame) -> DataFrame:
    """The one pass over the texts (columns ``id, text``): their candidates, one row per text that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                x = Look(text) if text else None
                if x is None or not x.cuts:
                    continue
                keep.append(i)
                starts = SEP.join(t for t, _ in x.starts) if x.starts else None
                pairs = SEP.join(t for _, t in x.starts) if x.starts else None
                out.append((x.first, np.array(x.cuts, np.int64).tobytes(), SEP.join(x.contexts), SEP.join(x.nexts), SEP.join(x.pairs), starts, pairs, np.array(x.alone, np.int64).tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = (pa.int32(), pa.binary(), *[pa.string()] * 5, pa.binary())
            ids = pa.array(keep, pa.int64())
            arrays = [batch.column(0).take(ids), batch.column(1).take(ids), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in LOOKED.split(", ")])

    return rows.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, LOOKED.format(id=rows.schema["id"].dataType.simpleString()))


class Coded(NamedTuple):
    """Tokens of a column: the spellings, and the number of each token's spelling."""

    words: list[str]
    index: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Coded:
        coded = pc.split_pattern(column, SEP).flatten().dictionary_encode()
        return cls(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False))

    @classmethod
    def listed(cls, words: list[str]) -> Coded:
        return cls(words, np.arange(len(words)))


class Candidates(NamedTuple):
    """The candidates of many texts, in whole arrays; ``doc`` is the number of each one's text."""

    doc: np.ndarray
    cuts: np.ndarray
    context: Coded
    next: Coded
    pair: Coded

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Candidates:
        blobs = batch.column("cuts").to_pylist()
        cuts = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 4)
        return cls(np.repeat(np.arange(len(blobs)), [len(x) // 32 for x in blobs]), cuts, *(Coded.of(batch.column(c)) for c in ("contexts", "nexts", "pairs")))

    @property
    def how(self) -> np.ndarray:
        return self.cuts[:, 2] >> 16

    def flag(self, shift: int, bits: int = 1) -> np.ndarray:
        return self.cuts[:, 2] >> shift & ((1 << bits) - 1)


def _suffix(prev: str, mark: str, closer: str) -> str:
    if len(prev) > 3:
        return "~" + prev[-3:] + mark + closer
    return "~" + ("A" if len(prev) == 1 and prev.isalpha() else "") + mark + closer


COUNTS = "k string, t string, edge long, other long"


def _counted(counts: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
    rows = [(k, t, e, o) for (k, t), (e, o) in counts.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["k", "t", "edge", "other"])


def _count_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what stands before marks, at the ends of paragraphs and elsewhere (with mark and closing signs, with mark, endings),
    of all candidates, and of lines that are paragraphs of their own."""
    n: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        c = Candidates.of(batch)
        is_mark = c.how == MARK
        size = len(c.context.words)
        last = c.flag(10).astype(bool)
        edge, other = (np.bincount(c.context.index[is_mark & m], minlength=size).tolist() for m in (last, ~last))
        for t, e, o in zip(c.context.words, edge, other, strict=True):
            if e or o:
                prev, mark, closer = t.split("\n")
                for k, key in (("p", prev + mark + closer), ("q", prev + mark), ("s", _suffix(prev, mark, closer)), ("total", "")):
                    at = n[k, key]
                    at[0] += e
                    at[1] += o
        for key, k in zip(*np.unique(np.frombuffer(b"".join(batch.column("alone").to_pylist()), np.int64), return_counts=True), strict=True):
            n["h", str(key)][0] += int(k)
        if len(n) > 300_000:
            yield _counted(n)
            n.clear()
    yield _counted(n)


def _count_after(model: Model):
    """Counts of what starts paragraphs, and of what follows other marks, unless an abbreviation stands before the mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            c = Candidates.of(batch)
            usual = np.array([model.context(t).odds > -1.6 for t in c.context.words])
            other = (c.how == MARK) & (c.flag(10) == 0) & usual[c.context.index]
            for k, coded, starts in (("n", c.next, "starts"), ("m", c.pair, "start_pairs")):
                for t, o in zip(coded.words, np.bincount(coded.index[other], minlength=len(coded.words)).tolist(), strict=True):
                    if t and o:
                        n[k, t][1] += o
                first = Coded.of(batch.column(starts))
                for t, e in zip(first.words, np.bincount(first.index, minlength=len(first.words)).tolist(), strict=True):
                    if t:
                        n[k, t][0] += e
            if len(n) > 300_000:
                yield _counted(n)
                n.clear()
        yield _counted(n)

    return run


#: How often a token of each kind must be seen: with mark and closing signs, with mark, suffix, next one, next two.
KINDS = {"p": 12, "q": 5, "s": 8, "n": 8, "m": 8}


class Context(NamedTuple):
    """What the counts say of the token before a mark."""

    odds: float
    known: bool
    suffix: float
    suffix_known: bool
    never: bool
    letters: int
    dotted: bool
    number: bool


class Model:
    """Token counts, headings (hashes of lines) and the weights of the classifier."""

    def __init__(self, counts: dict[str, dict[str, tuple[int, int]]], headings: frozenset[int]):
        self.counts, self.headings = counts, np.array(sorted(headings), np.int64)
        self.share = {}
        for kind in KINDS:
            # the share of boundaries that are paragraph ends: among tokens that have both
            both = [(e, o) for e, o in counts.get(kind, {}).values() if e and o and e + o >= 5]
            self.share[kind] = min(0.9, max(0.02, sum(e for e, _ in both) / max(1, sum(e + o for e, o in both)))) if both else 0.3
        self.weights = np.zeros(len(FEATURES))
        self.memo: dict[str, Context] = {}

    def odds(self, kind: str, token: str) -> tuple[float, bool]:
        """How much oftener than usual a token stands at a paragraph's edge, as a log; and whether it is known."""
        e, o = self.counts.get(kind, {}).get(token, (0, 0))
        if e + o < KINDS[kind]:
            return 0.0, False
        share = self.share[kind]
        return max(-6.0, min(2.0, math.log((e + 4 * share) / (e + o + 4) / share))), True

    def never(self, kind: str, token: str) -> bool:
        """A token that would surely have been seen at an edge if it could stand there."""
        e, o = self.counts.get(kind, {}).get(token, (0, 0))
        return e == 0 and (1 - self.share[kind]) ** o < 1e-3

    def context(self, text: str) -> Context:
        """Odds of the token before the mark: with the closing signs after it if these are common, else without; initials all together."""
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            prev, mark, closer = text.split("\n") if text else ("", "", "")
            suffix = _suffix(prev, mark, closer)
            if suffix.startswith("~A"):
                p, known = self.odds("s", suffix)
            else:
                p, known = self.odds("p", prev + mark + closer)
                if not known:
                    p, known = self.odds("q", prev + mark)
            sfx, s_known = self.odds("s", suffix)
            got = self.memo[text] = Context(p, known, sfx, s_known, self.never("p", prev + mark + closer), len(prev), "." in prev, prev.startswith("<"))
        return got

    def read(self, c: Candidates) -> tuple[np.ndarray, np.ndarray]:
        """(features, reliable label) of candidates; the label is 1 for a sure boundary, 0 for a sure none, -1 for what is to be decided."""
        ctx = np.array([self.context(t) for t in c.context.words], float).reshape(-1, len(Context._fields))[c.context.index]
        after = lambda kind, coded: np.array([(*self.odds(kind, t), self.never(kind, t), t.startswith("<"), bool(t)) for t in coded.words], float).reshape(-1, 5)[coded.index]
        n, m = after("n", c.next), after("m", c.pair)
        p, p_known, sfx, s_known, p_never, letters, dotted, number = ctx.T
        kind, closer, case, opener, caps, last = c.flag(0, 2), c.flag(2, 2), c.flag(4, 3), c.flag(7, 2), c.flag(9), c.flag(10).astype(bool)
        x = np.stack(
            [
                np.ones(len(p)), p, p_known, np.where(p_known > 0, 0.0, sfx), (p_known == 0) & (s_known > 0), n[:, 0], n[:, 1], m[:, 0], m[:, 1],
                kind == 1, kind == 2, kind == 3, closer == 1, closer == 2, letters == 1, letters == 2, dotted, number, n[:, 3],
                opener == 1, opener == 2, case == CASES.index("none"), caps,
            ], axis=1,
        ).astype(float)
        upper, none, digit = (case == CASES.index(k) for k in ("upper", "none", "digit"))
        sure = (p_known > 0) & (n[:, 1] > 0) & (p > -0.7) & (n[:, 0] > -0.7) & (letters > 2) & ~digit
        label = np.where((case <= 1) | (p_never > 0) | (n[:, 2] > 0) | (m[:, 2] > 0), 0, np.where(sure, 1, -1))
        label = np.where(last, np.where((n[:, 4] > 0) & (upper | none), 1, -1), label)
        return x, np.where(c.how == MARK, label, -1)

    def accepted(self, c: Candidates) -> np.ndarray:
        """Which candidates are boundaries."""
        x, _ = self.read(c)
        case, how = c.flag(4, 3), c.how
        by_mark = (c.flag(10) == 1) | (case != 0) & ~((case == 1) & (c.flag(7, 2) == 0)) & (x @ self.weights > 0)
        known = np.zeros(len(how), bool)
        if len(self.headings):
            known = self.headings[np.minimum(np.searchsorted(self.headings, c.cuts[:, 3]), len(self.headings) - 1)] == c.cuts[:, 3]
        starts, seen, titled = x[:, FEATURES.index("next")], x[:, FEATURES.index("next_known")] > 0, c.flag(11) == 1
        by_form = np.where(titled, ~seen | (starts > -0.7), seen & (starts > 0))
        return np.select([how == MARK, how == SURE, how == KNOWN], [by_mark, True, known], by_form).astype(bool)


FEATURES = (
    "bias", "prev", "prev_known", "suffix", "suffix_known", "next", "next_known", "pair", "pair_known", "cry", "dots", "spaced_dots", "bracket", "quote",
    "one_letter", "two_letters", "inner_stop", "after_number", "before_number", "inverted", "opening", "caseless", "capitals",
)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Maximum-entropy weights by Newton steps; classes weigh the same; the prior keeps the evidence of both neighbours."""
    prior = np.zeros(x.shape[1])
    for name, w in (("prev", 1.0), ("suffix", 1.0), ("next", 1.0), ("pair", 0.5)):
        prior[FEATURES.index(name)] = w
    prior[0] = 1.5
    if not len(y):
        return prior
    ones, zeros = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    c = np.where(y == 1, 0.5 / ones, 0.5 / zeros) * min(len(y), 4000)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (y - p)) - ridge * (w - prior)
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(texts: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a column of texts (first column, no nulls)."""
    rows = texts.select(F.lit(0).alias("id"), F.col(texts.columns[0]).alias("text"))
    return _learn(written(look(rows), "sentence-candidates"), sample)


def _learn(looked: DataFrame, sample: int = SAMPLE) -> Model:
    by: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)

    def gather(counted: DataFrame, least: int) -> None:
        sums = counted.groupBy("k", "t").agg(F.sum("edge").alias("edge"), F.sum("other").alias("other"))
        for r in sums.filter(F.col("edge") + F.col("other") >= least).collect():
            by[r["k"]][r["t"]] = (r["edge"], r["other"])

    before = written(looked.mapInArrow(_count_before, COUNTS), "sentence-counts")
    total = before.filter("k = 'total'").agg(F.sum(F.col("edge") + F.col("other"))).first()[0] or 0
    least = max(3, KEPT * total)
    gather(before.filter("k in ('p', 'q', 's')"), least)
    # A line of its own is as often a paragraph of its own as a token must be seen, five times at least.
    gather(before.filter("k = 'h'"), max(5, 4 * KEPT * total))
    headings = frozenset(int(t) for t in by.pop("h", {}))
    gather(looked.mapInArrow(_count_after(Model(dict(by), frozenset())), COUNTS), least)
    model = Model(dict(by), headings)
    shared = looked.sparkSession.sparkContext.broadcast(model)

    def reliable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Candidates.of(batch)
            x, y = shared.value.read(c)
            found = np.flatnonzero(y >= 0)
            # of a text with very many, every n-th
            n = np.bincount(c.doc[found], minlength=batch.num_rows)
            place = np.arange(len(found)) - (np.cumsum(n) - n)[c.doc[found]]
            found = found[place % (1 + n // 1000)[c.doc[found]] == 0]
            yield pa.RecordBatch.from_arrays([pa.array(list(x[found]), pa.list_(pa.float64())), pa.array(y[found].astype(np.int32))], names=["x", "y"])

    # Whole texts are drawn by their hash, each different text once, so that about ``sample`` sites come: a few thousand texts.
    share = min(1.0, sample / max(1, total))
    drawn = looked.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])
    got = sorted(drawn.mapInArrow(reliable, "x array<double>, y int").collect(), key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, len(FEATURES)))
    model.weights = fit_weights(x, np.array([r["y"] for r in got], float))
    model.memo.clear()
    return model


def _units(c: Candidates, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the units between accepted candidates; ``first`` is where each text starts."""
    yes = np.flatnonzero(model.accepted(c))
    doc, end, on = c.doc[yes], c.cuts[yes, 0], c.cuts[yes, 1]
    new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    start = np.where(new, first[doc], np.r_[0, on[:-1]] if len(on) else on)
    ok = (start >= 0) & (start < end)
    return doc[ok], start[ok], end[ok]


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Units of a text as (start, end) in code points, end exclusive; null and blank texts have none."""
    x = Look(text) if text else None
    if x is None or not x.cuts:
        return []
    c = Candidates(np.zeros(len(x.cuts), int), np.array(x.cuts, np.int64), *map(Coded.listed, (x.contexts, x.nexts, x.pairs)))
    _, start, end = _units(c, np.array([x.first]), model)
    return list(zip(start.tolist(), end.tolist(), strict=True))


def sentences(df: DataFrame, id_col: str, text_col: str, model: Model | None = None, with_text: bool = False) -> DataFrame:
    """``id_col, start_char, end_char`` (and ``sentence``): one row per unit, offsets in code points.

    The model is learned from df unless one is given. Null and blank texts have no rows; repeated
    ids keep theirs; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    looked = look(rows)
    if model is None:
        looked = written(looked, "sentence-candidates")
        model = _learn(looked)
    if with_text:
        return with_sentences(df, id_col, text_col, model)
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, end = _units(Candidates.of(batch), batch.column("first").to_numpy(), shared.value)
            ids = batch.column("id").take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=[id_col, "start_char", "end_char"])

    return looked.mapInArrow(run, f"`{id_col}` {id_type}, start_char int, end_char int")


def with_sentences(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """The units with their text, by a model already learned; one pass over the texts."""
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, text[a:b]) for i, text in enumerate(batch.column(1).to_pylist()) for a, b in split(text, shared.value)]
            at, start, end, said = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(said, pa.string())], names=[id_col, "start_char", "end_char", "sentence"]
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, start_char int, end_char int, sentence string")
