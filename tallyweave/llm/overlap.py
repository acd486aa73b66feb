"""Same and nearly same records across splits.

The distinct texts of the evaluation splits are put into shards, and each shard into a compressed
full-text index (fm_index) that is written to the shared folder. The distinct training texts then
stream through the shards in one pass, without a shuffle.

Two texts of at most ``n`` words that differ in at most ``d`` words share one of ``d + 1`` pieces
that a text is cut into, whatever the cut. So each training text is cut into as many pieces as its
length allows edits, plus one; backward search counts each piece of several cuts, and the cut with
the fewest occurrences is located. Every occurrence is extended to its maximal match, and the matches of
a pair of texts are merged to spans. The words that a chain of the matches leaves out bound the pair's word distance:
if the bound is allowed, the pair is kept; the distance itself is worked out only where the bound decides nothing or
is not known to be exact. No frequency cap is needed, as no piece is ever left out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.ids import nine_digits
from tallyweave.llm.fm_index import FmIndex, within
from tallyweave.llm.lookalike import consistent_form
from tallyweave.session import written, written_path

#: Words in one shard of the index: about 30 MB when loaded. Speed and memory depend on it, results don't.
SHARD_WORDS = 1_000_000
#: Cuts of a text into pieces that are tried.
CUTS = 6
#: Occurrences of a text's pieces that are few enough to try no other cut; only speed depends on it.
RARE = 8
#: Training words held before they are searched in every shard.
HELD_WORDS = 2_000_000
#: Located occurrences handled at once.
AT_ONCE = 1_000_000
#: Loaded shards that a process keeps, about 30 MB each; an index of no more is loaded once per process. Speed depends on it, results don't.
KEPT_SHARDS = 4

_APOSTROPHES = regex.compile(r"(?<=\p{L})['’](?=\p{L})")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|[\p{L}\p{M}\p{N}]+")


#: For ASCII texts: everything but letters and digits is a blank.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(form: str | None) -> list[str]:
    """The words of a consistent form: without case, punctuation and blanks."""
    if not form:
        return []
    text = form.casefold()
    if "'" in text or "’" in text:
        text = _APOSTROPHES.sub("", text)
    return text.translate(_BLANKS).split() if text.isascii() else _WORD.findall(text)


def allowed(longer: np.ndarray | int, share: int):
    """Word differences allowed at the longer text's length: one in ``share``."""
    return longer // share


def _hash(ws: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) >> 1 for w in ws]


def _word_rows(df: DataFrame, least: int) -> DataFrame:
    """id, side columns, the words of each text's form, joined by blanks, and 16 bytes for them; null if there are fewer than ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = []
            for text in batch.column(3).to_pylist():
                w = words(consistent_form(text))
                norms.append(" ".join(w) if len(w) >= least else None)
            keys = [None if t is None else xxhash.xxh3_128_digest(t) for t in norms]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norms, pa.string()), pa.array(keys, pa.binary())], names=["id", "train", "ein", "norm", "key"])

    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "train", "ein", "text").mapInArrow(run, f"id {id_type}, train boolean, ein string, norm string, key binary")


def _shards(texts: DataFrame, shard_words: int) -> str:
    """Writes one index per shard of the distinct evaluation texts; returns the folder."""
    sized = texts.select("key", "norm", F.size(F.split("norm", " ")).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_words))

    def build(key, table):
        split = [t.split(" ") for t in table.column("norm").to_pylist()]
        hashes = np.array([h for ws in split for h in _hash(ws)], np.int64)
        index = FmIndex.build(hashes, np.array([len(ws) for ws in split], np.int64))
        keys = b"".join(table.column("key").to_pylist())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys], pa.binary()), "blob": pa.array([index.dump()], pa.binary())})

    by = sized.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")).select("shard", "key", "norm")
    return written_path(by.groupBy("shard").applyInArrow(build, "shard int, keys binary, blob binary"), "overlap-index")


_kept: OrderedDict[tuple[str, int], list[tuple[FmIndex, np.ndarray]]] = OrderedDict()


def _load_shards(folder: str) -> Iterator[tuple[FmIndex, np.ndarray]]:
    """The shards of a written index, one at a time. ``folder`` is a URI with its scheme, as Spark resolved it."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(folder)
    for f in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path):
        if not f.path.endswith(".parquet"):
            continue
        source = None
        k = 0
        while True:
            if (f.path, k) not in _kept:
                source = source or pq.ParquetFile(fs.open_input_file(f.path))
                if k >= source.num_row_groups:
                    break
                rows = source.read_row_group(k).to_pylist()
                _kept[f.path, k] = [(FmIndex.load(r["blob"]), np.frombuffer(r["keys"], "S16")) for r in rows]
                while len(_kept) > KEPT_SHARDS:
                    _kept.popitem(last=False)
            yield from _kept[f.path, k]
            k += 1


def _cut(n: np.ndarray, share: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts of n words, k-th cut: text number, first and last word. Any cut has enough pieces."""
    pieces = n * share // (share - 1) // share + 1
    text = np.repeat(np.arange(len(n)), pieces)
    i = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    p, m = pieces[text], n[text]
    # Bounds move by k sixths of a piece, one way for odd bounds and the other for even ones.
    bound = lambda j: np.where(j <= 0, 0, np.where(j >= p, m, (j * m) // p + (((-1) ** (j & 1)) * k * m) // (p * 2 * CUTS)))
    return text, bound(i), bound(i + 1)


def _search(index: FmIndex, hashes: np.ndarray, starts: np.ndarray, n: np.ndarray, share: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, document, edits, matched words, spans) for each pair within the allowed distance."""
    ids = index.ids(hashes)
    best = np.full(len(n), np.iinfo(np.int64).max)
    chosen: list[tuple[np.ndarray, ...]] = []
    for k in range(CUTS):
        # Texts whose pieces are rare enough already need no other cut.
        live = np.flatnonzero(best > RARE)
        if not len(live):
            break
        text, first, last = _cut(n[live], share, k)
        text = live[text]
        low, high = index.backward(ids, starts[text] + first, starts[text] + last)
        cost = np.bincount(text, high - low, len(n)).astype(np.int64)
        better = np.zeros(len(n), bool)
        better[live] = cost[live] < best[live]
        best = np.where(better, cost, best)
        chosen = [tuple(x[~better[c[0]]] for x in c) for c in chosen]
        mine = better[text]
        chosen.append((text[mine], first[mine], low[mine], high[mine]))
    text, first, low, high = (np.concatenate(x) for x in zip(*chosen, strict=True))
    order = np.argsort(text, kind="stable")
    text, first, low, high = text[order], first[order], low[order], high[order]
    count = high - low
    lengths = np.diff(np.r_[index.starts, len(index.text)]) - 1
    block = np.cumsum(best) // AT_ONCE  # whole texts, so that a pair's matches stay together
    for b in np.unique(block[best > 0]):
        mine = np.flatnonzero((block[text] == b) & (count > 0))
        total = count[mine]
        rows = np.repeat(low[mine] - (np.cumsum(total) - total), total) + np.arange(total.sum())
        place = index.places(rows)
        t, at = np.repeat(text[mine], total), np.repeat(first[mine], total)
        doc = np.searchsorted(index.starts, place, "right") - 1
        x, y = at, place - index.starts[doc]
        longer = np.maximum(n[t], lengths[doc])
        most = allowed(longer, share)
        # The piece's diagonal and the lengths bound the edits before and after it.
        ok = np.maximum(np.abs(x - y), np.abs(n[t] - lengths[doc])) <= most
        t, doc, x, y = t[ok], doc[ok], x[ok], y[ok]
        pair, inverse = np.unique(t.astype(np.int64) * len(lengths) + doc, return_inverse=True)
        if not len(pair):
            continue
        pt, pd = pair // len(lengths), pair % len(lengths)
        pm = allowed(np.maximum(n[pt], lengths[pd]), share)
        left, right = _maximal(ids, starts[t], n[t], x, index.text, index.starts[doc], lengths[doc], y)
        edits = _chained(inverse, left, right, y - x, n[pt], lengths[pd])
        kept = edits <= pm
        # A bound that is as low as the lengths allow, or one edit between texts that differ, is the distance.
        open_ = np.flatnonzero(edits > np.maximum(np.abs(n[pt] - lengths[pd]), 1))
        for top in np.unique(pm[open_]):  # alike lengths together, so that short texts don't wait for long ones
            these = open_[pm[open_] == top]
            for part in np.array_split(these, max(1, len(these) * (2 * int(top) + 3) // 4_000_000)):
                found = within(ids, starts[pt[part]], n[pt[part]], index.text, index.starts[pd[part]], lengths[pd[part]], pm[part])
                edits[part] = np.where(found >= 0, found, edits[part])
                kept[part] |= found >= 0
        use = kept[inverse]
        covered, spans = _merged(inverse[use], left[use], right[use], len(pair))
        yield pt[kept], pd[kept], edits[kept], covered[kept], spans[kept]


def _chained(pair: np.ndarray, left: np.ndarray, right: np.ndarray, shift: np.ndarray, an: np.ndarray, bn: np.ndarray) -> np.ndarray:
    """For each pair, the edits along a chain of its maximal matches: an upper bound of its word distance.

    Matches are taken from left to right, each from where it leaves the chain behind in both texts; what lies between two
    matches costs the longer of its two sides.
    """
    one = np.unique(np.stack([pair, left, shift, right]), axis=1) if len(pair) else np.zeros((4, 0), np.int64)
    pair, left, shift, right = one
    place = np.arange(len(pair)) - np.searchsorted(pair, pair)
    ea, eb, cost = (np.zeros(len(an), np.int64) for _ in range(3))
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(place.max() + 2 if len(place) else 1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        m = order[a:b]
        p = pair[m]
        at = np.maximum(left[m], np.maximum(ea[p], eb[p] - shift[m]))
        ok = at < right[m]
        m, p, at = m[ok], p[ok], at[ok]
        cost[p] += np.maximum(at - ea[p], at + shift[m] - eb[p])
        ea[p], eb[p] = right[m], right[m] + shift[m]
    return cost + np.maximum(an - ea, bn - eb)


def _maximal(a, a0, an, x, b, b0, bn, y) -> tuple[np.ndarray, np.ndarray]:
    """First and last word in a of the maximal match around each common place."""
    left, right = x.copy(), x.copy()
    shift = y - x
    for edge, by in ((right, 1), (left, -1)):
        live = np.arange(len(x))
        while len(live):
            to = edge[live] + (0 if by > 0 else -1)
            inside = (to >= 0) & (to < an[live]) & (to + shift[live] >= 0) & (to + shift[live] < bn[live])
            live, to = live[inside], to[inside]
            same = a[a0[live] + to] == b[b0[live] + to + shift[live]]
            live = live[same]
            edge[live] += by
    return left, right


def _merged(group: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by the union of each group's spans, and the number of separate spans."""
    covered, spans = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(group):
        order = np.lexsort((left, group))
        g, lo, hi = group[order], left[order], right[order]
        wide = int(hi.max()) + 2
        reach = np.maximum.accumulate(hi + g * wide) - g * wide
        before = np.r_[0, np.where(g[1:] == g[:-1], reach[:-1], 0)]
        new = np.r_[True, (g[1:] != g[:-1]) | (lo[1:] > reach[:-1])]
        np.add.at(covered, g, np.maximum(0, hi - np.maximum(lo, before)))
        np.add.at(spans, g, new.astype(np.int64))
    return covered, spans


def text_overlaps(train: DataFrame, evaluation: DataFrame, share: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``train_key, eval_key, edits, matched_words, spans`` of distinct texts (columns ``key binary(16), norm``)."""
    folder = _shards(evaluation, shard_words)

    def search(texts: list[tuple[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(h) for _, h in texts], np.int64)
        hashes = np.array([x for _, h in texts for x in h], np.int64)
        starts = np.cumsum(n) - n
        keys = np.array([k for k, _ in texts], "S16")
        for index, docs in _load_shards(folder):
            for t, d, *facts in _search(index, hashes, starts, n, share):
                binary = lambda k, i: pa.array([bytes(x).ljust(16, b"\0") for x in k[i]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [binary(keys, t), binary(docs, d), *(pa.array(f, pa.int64()) for f in facts)],
                    names=["train_key", "eval_key", "edits", "matched_words", "spans"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[bytes, list[int]]] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.append((key, _hash(text.split(" "))))
                held += len(texts[-1][1])
            if held >= HELD_WORDS:
                yield from search(texts)
                texts, held = [], 0
        if texts:
            yield from search(texts)

    return train.select("key", "norm").mapInArrow(run, "train_key binary, eval_key binary, edits long, matched_words long, spans long")


def overlaps(df: DataFrame, id_col: str, text_col: str, ein_col: str, split_col: str, train: str = "train", share: int = 10, least: int = 8) -> DataFrame:
    """``id_a, id_b, train_id, eval_id, by_text, edits, matched_words, spans``: every pair of a training and an evaluation row
    with the same nine EIN digits, or with texts that differ in at most one word in ``share``.

    Each pair comes once. Null and short texts (fewer than ``least`` words) count by EIN only, null
    EINs by text only, rows without a split by neither. Pairs found by text have ``by_text`` true.
    """
    split = F.lower(F.trim(split_col))
    rows = df.filter(F.col(split_col).isNotNull()).select(F.col(id_col).alias("id"), (split == train).alias("train"), nine_digits(ein_col).alias("ein"), F.col(text_col).alias("text"))
    rows = written(_word_rows(rows, least), "overlap-rows")
    kinds = rows.filter("norm is not null").groupBy("key").agg(F.first("norm").alias("norm"), F.max("train").alias("in_train"), F.min("train").alias("only_train"))
    found = text_overlaps(kinds.filter("in_train"), kinds.filter("not only_train"), share)
    a = rows.filter("train").select(F.col("key").alias("train_key"), F.col("id").alias("train_id"), F.col("ein").alias("train_ein"))
    b = rows.filter("not train").select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id"), F.col("ein").alias("eval_ein"))
    by_text = (
        found.join(a, "train_key").join(b, "eval_key")
        .filter(~F.coalesce(F.col("train_ein") == F.col("eval_ein"), F.lit(False)))
        .select("train_id", "eval_id", F.lit(True).alias("by_text"), "edits", "matched_words", "spans")
    )
    none = F.lit(None).cast("long")
    by_ein = a.join(b, F.col("train_ein") == F.col("eval_ein")).select("train_id", "eval_id", F.lit(False).alias("by_text"), none.alias("edits"), none.alias("matched_words"), none.alias("spans"))
    return by_text.unionByName(by_ein).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"), "*")


def report(df: DataFrame, pairs: DataFrame, id_col: str, split_col: str, source_col: str, train: str = "train") -> DataFrame:
    """Per split and source: rows, rows with an overlap, pairs, and over the pairs found by text their spans and matched words;
    training rows are reported under their own split."""
    ends = pairs.select(F.explode(F.array("train_id", "eval_id")).alias("__id"), "matched_words", "spans")
    per_row = ends.groupBy("__id").agg(F.count("*").alias("__pairs"), F.sum("spans").alias("__spans"), F.sum("matched_words").alias("__words"))
    rows = df.select(F.col(id_col).alias("__id"), F.lower(F.trim(split_col)).alias("split"), F.col(source_col).alias("data_source"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.join(per_row, "__id", "left").groupBy("split", "data_source").agg(F.count("*").alias("n_rows"), F.count("__pairs").alias("n_overlapping"), total("__pairs").alias("n_pairs"), total("__spans").alias("n_spans"), total("__words").alias("matched_words"))
