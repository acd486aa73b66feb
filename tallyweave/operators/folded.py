"""The text classifiers of all folds: texts are read and hashed once, and each fold's classifier is fitted by a task of its own that goes over the written term counts.

A fold's model is the one that ``ml.fit_tfidf`` describes, with inverse document frequencies, class weights and penalty of the rows outside the fold.
Rows keep hashed term counts; frequencies and lengths differ by fold, so they are applied as rows are read.

A fit goes up the dual of the penalised loss row by row: each row's share in the model is set to its best value with the others as they are. As a row's length is bounded
and the penalty doesn't grow with the rows, the passes that this takes don't either, if each has a random order of its own: for that, counts are read from mapped files.
A task holds vectors as long as the features and a few numbers per row.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tallyweave.session import shared_folder, written_path

KINDS = ("words", "chars")
#: A row's terms: places and counts, first those of words, and how many of them are words.
COUNTS = ["__at", "__n", "__long"]
#: Rows of one block: its columns stay in the processor's cache.
BLOCK = 256
#: What a task writes of its rows: places and counts of all terms, and the numbers that each row has. A count takes ``size`` bytes: 1, or 4 in rows with a count above 255.
FILES = {"at": np.dtype(np.int32), "n": np.dtype(np.uint8), "rows": np.dtype([("fold", np.int32), ("y", np.int32), ("words", np.int32), ("size", np.int32), ("terms", np.int64)])}
#: Length of the gradient at which a fit has settled, per unit of the penalty. On check_l the scores at a length of 3 are within 0.02 of those at 0.02.
SETTLED = 2e-2


def scores(df: DataFrame, text: str, label: str, fold: str = "fold", c: float = 1.0, features: int = 1 << 18, max_iter: int = 2000) -> DataFrame:
    """df with ``prob_raw``, by the model of the other folds' rows. Labels are 0 and 1.

    What reaches the driver is a vector as long as the features per fold, and the rows that have a term by fold and task. A fit that has not settled
    after max_iter passes over its rows is reported by a warning.
    """
    spark = df.sparkSession
    seen = df.groupBy(fold, label).count().limit(10_000).collect()
    names = sorted({r[fold] for r in seen})
    if strange := {r[label] for r in seen} - {0, 1}:
        raise ValueError(f"labels must be 0 or 1, not {', '.join(sorted(map(str, strange)))}")
    if len(names) < 2:
        raise ValueError("at least two folds are needed")
    inside = np.zeros((len(names), 2))
    for r in seen:
        inside[names.index(r[fold]), int(r[label])] += r["count"]
    outside = inside.sum(axis=0) - inside
    rows, classes = outside.sum(axis=1), (outside > 0).sum(axis=1)
    weights = np.divide(rows[:, None], classes[:, None] * outside, out=np.zeros_like(outside), where=outside > 0)

    cores = spark.sparkContext.defaultParallelism
    number = F.create_map(*[F.lit(x) for kv in enumerate(names) for x in kv[::-1]])
    numbered = df.repartition(2 * cores).withColumn("__fold", number[F.col(fold)]).withColumn("__y", F.col(label).cast("double"))
    counted, schema = _counted(numbered, df.columns, text, features)
    counts = spark.read.schema(schema).parquet(written_path(counted, "folds-counts"))

    folder, parts = f"{shared_folder(spark)}/folds-rows-{uuid.uuid4().hex}", []
    found = np.zeros(len(names) * 2 * features)
    for r in counts.coalesce(cores).select("__fold", "__y", *COUNTS).mapInArrow(_laid_out(folder, len(names), 2 * features), "part string, at binary, n binary").collect():
        parts.append(r["part"])
        found[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int32)
    found = found.reshape(len(names), -1)
    rarity = (np.log((1 + rows[:, None]) / (1 + found.sum(axis=0) - found)) + 1.0).astype(np.float32)
    del found

    shared = spark.sparkContext.broadcast(rarity)
    models, intercepts = np.zeros_like(rarity), np.zeros(len(names))
    intercepts[classes == 1] = np.where(weights[classes == 1, 1] > 0, np.inf, -np.inf)
    # ml.penalty is for Spark's mean loss; over the sum it is 1 / c, as balanced weights add up to the rows.
    fits = spark.range(0, len(names), 1, len(names)).mapInArrow(_fits(folder, parts, shared, weights, classes, 1.0 / c, max_iter), "fold long, intercept double, length double, passes long, terms binary")
    for r in fits.collect():
        models[r["fold"]], intercepts[r["fold"]] = np.frombuffer(r["terms"], np.float32), r["intercept"]
        if r["length"] > SETTLED / c:
            warnings.warn(f"not settled: the gradient's length is still {r['length']:.1e}", stacklevel=2)
    z = spark.sparkContext.broadcast((models, intercepts))
    out = StructType([*df.schema.fields, StructField("prob_raw", DoubleType())])
    return counts.mapInArrow(_scored(shared, z, df.columns), out)


def _counted(df: DataFrame, keep: list[str], text: str, features: int) -> tuple[DataFrame, StructType]:
    """The rows with the places and counts of their hashed terms as packed numbers."""
    from tallyweave.operators.ml import with_terms

    t = with_terms(df, text)
    for k in KINDS:
        t = HashingTF(inputCol=f"__{k}", outputCol=f"__{k}_tf", numFeatures=features).transform(t).withColumn(f"__{k}_tf", F.unwrap_udt(f"__{k}_tf"))
    lists = [F.col(f"__{k}_tf")[x].alias(f"__{k}_{x}") for k in KINDS for x in ("indices", "values")]
    kept = [*keep, "__fold", "__y"]
    schema = StructType([*df.select(*kept).schema.fields, *[StructField(x, IntegerType() if x == "__long" else BinaryType()) for x in COUNTS]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([*[b.column(x) for x in kept], *_packed(b, features)], names=[*kept, *COUNTS])

    return t.select(*kept, *lists).mapInArrow(run, schema), schema


def _packed(b: pa.RecordBatch, features: int) -> list[pa.Array]:
    """The columns COUNTS: words and characters row by row in one list, places of characters after those of words, as binary columns of the numbers."""
    ends = [b.column(f"__{k}_indices").offsets.to_numpy() for k in KINDS]
    longs = np.column_stack([np.diff(e) for e in ends])
    words = np.tile([True, False], b.num_rows).repeat(longs.ravel())
    bounds = np.concatenate([[0], np.cumsum(longs.sum(axis=1))]) * 4
    out = []
    for x, kind, more in (("indices", np.int32, features), ("values", np.float32, 0)):
        values = np.empty(len(words), kind)
        for part, e, k, add in zip((words, ~words), ends, KINDS, (0, more), strict=True):
            values[part] = b.column(f"__{k}_{x}").values.to_numpy()[e[0] : e[-1]] + kind(add)
        out.append(pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values)]))
    return [*out, pa.array(longs[:, 0], pa.int32())]


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a packed column in one array, and where each row's begin and the last one's end."""
    size = np.dtype(kind).itemsize
    _, ends, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return values, (ends - ends[0]) // size


class _Terms:
    """Places and counts of the terms of a block of rows, row by row; of each row the first ``words`` are words."""

    def __init__(self, at: np.ndarray, n: np.ndarray, words: np.ndarray, ends: np.ndarray):
        self.at, self.n, self.ends = at.astype(np.int64), n.astype(float), ends
        self.long = np.column_stack([words, np.diff(ends) - words]).ravel()
        self.starts, self.some = np.cumsum(self.long) - self.long, np.flatnonzero(self.long)

    @classmethod
    def read(cls, block: pa.RecordBatch) -> _Terms:
        at, ends = _numbers(block.column("__at"), np.int32)
        return cls(at, _numbers(block.column("__n"), np.float32)[0], block.column("__long").to_numpy(), ends)

    def of(self, by_row: np.ndarray) -> np.ndarray:
        return by_row.repeat(np.diff(self.ends))

    def sums(self, terms: np.ndarray) -> np.ndarray:
        """Sums over the terms, by row and kind."""
        out = np.zeros(len(self.long))
        if len(self.some):
            out[self.some] = np.add.reduceat(terms, self.starts[self.some])
        return out.reshape(-1, 2)

    def weighted(self, squares: np.ndarray) -> np.ndarray:
        """The counts over the length that a row's terms of a kind have by their squared rarities, ``squares``."""
        length = np.sqrt(self.sums(np.square(self.n) * squares))
        return self.n * np.divide(1, length, out=np.zeros_like(length), where=length > 0).ravel().repeat(self.long)


def _blocks(batches):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _laid_out(folder: str, k: int, places: int):
    """Writes FILES for a task's rows; gives their name and the rows that have a term, per fold. ``folder`` is a URI with its scheme, as Spark resolved it."""

    def run(batches):
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        # A task that is run again writes other files.
        part, found = uuid.uuid4().hex, np.zeros(k * places, np.int32)
        with fs.open_output_stream(f"{path}/{part}.at") as at, fs.open_output_stream(f"{path}/{part}.n") as n, fs.open_output_stream(f"{path}/{part}.rows") as rows:
            for block in _blocks(batches):
                places_of, ends = _numbers(block.column("__at"), np.int32)
                own = np.zeros(block.num_rows, FILES["rows"])
                own["fold"], own["y"], own["words"], own["terms"] = block.column("__fold").to_numpy(), block.column("__y").to_numpy(), block.column("__long").to_numpy(), np.diff(ends)
                at.write(places_of.tobytes())
                counts = _numbers(block.column("__n"), np.float32)[0]
                own["size"] = [1 if counts[a:b].max(initial=0) < 256 else 4 for a, b in zip(ends, ends[1:], strict=False)]
                for a, b, size in zip(ends, ends[1:], own["size"], strict=False):
                    n.write((counts[a:b].astype(np.uint8) if size == 1 else counts[a:b]).tobytes())
                rows.write(own.tobytes())
                np.add.at(found, own["fold"].astype(np.int64).repeat(own["terms"]) * places + places_of, np.int32(1))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([some.astype(np.int32).tobytes()]), pa.array([found[some].tobytes()])], names=["part", "at", "n"])

    return run


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _mapped(path: str, kind: np.dtype) -> np.ndarray:
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)


class _Rows:
    """The rows outside a fold, mapped from the written files; those of a file system that can't be mapped are copied to ``near`` first."""

    def __init__(self, folder: str, parts: list[str], fold: int, near: str):
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        if not isinstance(fs, pafs.LocalFileSystem):
            for name in (f"{p}.{kind}" for p in parts for kind in FILES):
                with fs.open_input_stream(f"{path}/{name}") as a, open(f"{near}/{name}", "wb") as b:
                    shutil.copyfileobj(a, b, 1 << 24)
            path = near
        found = [{k: _mapped(f"{path}/{p}.{k}", kind) for k, kind in FILES.items()} for p in parts]
        rows = [np.array(x["rows"]) for x in found]
        self.files = [(x["at"], x["n"]) for x in found]
        first, byte = (np.concatenate([np.cumsum(long) - long for long in longs]) for longs in ([r["terms"] for r in rows], [r["terms"] * r["size"] for r in rows]))
        file, all_rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        own = all_rows["fold"] != fold
        self.file, self.first, self.byte = file[own], first[own], byte[own]
        self.y, self.words, self.size, self.long = (all_rows[x][own] for x in ("y", "words", "size", "terms"))

    def __len__(self) -> int:
        return len(self.y)

    def blocks(self, order: np.ndarray):
        """(rows, terms) of one block after the other."""
        for low in range(0, len(order), BLOCK):
            i = order[low : low + BLOCK]
            file, long = self.file[i].tolist(), self.long[i]
            at = [self.files[f][0][a:b] for f, a, b in zip(file, self.first[i].tolist(), (self.first[i] + long).tolist(), strict=True)]
            n = [self.files[f][1][a:b] for f, a, b in zip(file, self.byte[i].tolist(), (self.byte[i] + long * self.size[i]).tolist(), strict=True)]
            for k in np.flatnonzero(self.size[i] > 1):
                n[k] = n[k].view(np.float32)
            yield i, _Terms(np.concatenate(at), np.concatenate(n), self.words[i], np.concatenate([[0], np.cumsum(long)]))


class _Fit:
    """The classifier of the rows outside a fold. Its coefficients are a sum over rows, each times its share; ``terms`` are coefficients times rarities."""

    def __init__(self, rows: _Rows, rarity: np.ndarray, weights: np.ndarray, penalty: float, seed: int):
        self.rows, self.rarity, self.penalty = rows, rarity.astype(float), penalty
        self.squares, self.weights = np.square(self.rarity), weights[rows.y]
        self.terms, self.shares = np.zeros(len(rarity)), np.zeros(len(rows))
        self.total = self.intercept = 0.0
        self.random = np.random.default_rng(seed)

    def settle(self, max_iter: int) -> tuple[float, int]:
        """The gradient's length at the end, and the passes over the rows."""
        limit, by = SETTLED * self.penalty, 1.0
        for k in range(1, max_iter + 1):
            seen = self.climb()
            # Working out the gradient takes as long as a pass: it waits until what the rows were off by makes it likely to be short.
            if seen * by <= limit or k == max_iter:
                length = self.slope()
                if length <= limit:
                    break
                by = length / max(seen, 1e-300)
        return length, k

    def climb(self) -> float:
        """Sets each row's share once, in random order; returns a length of what they were off by.

        The intercept is a term of every row. Its penalty counts from its mean in the pass before, so that it fades.
        """
        terms, penalty, total, off, gone = self.terms, self.penalty, self.total, 0.0, 0.0
        for rows, t in self.rows.blocks(self.random.permutation(len(self.rows))):
            squares = self.squares.take(t.at)
            x = t.weighted(squares)
            step = x * (squares / penalty)
            norms = (((t.long.reshape(-1, 2) > 0).sum(axis=1) + 1) / penalty).tolist()
            shares, w, ends = self.shares[rows].tolist(), self.weights[rows].tolist(), t.ends.tolist()
            full = (self.weights[rows] * self.rows.y[rows]).tolist()
            for i in range(len(rows)):
                part = slice(ends[i], ends[i + 1])
                at = t.at[part]
                now = terms.take(at, mode="clip")
                z = float(now.dot(x[part])) + self.intercept + total / penalty
                short = shares[i] - full[i]
                by = (_risen(z, norms[i], short, w[i]) - z) / norms[i]
                off += (short + w[i] * _chance(z)) ** 2 * norms[i]
                shares[i] += by
                total += by
                gone += total
                now += step[part] * by
                terms[at] = now
            self.shares[rows] = shares
        self.total = total
        self.intercept += gone / len(self.rows) / penalty
        return math.sqrt(off)

    def slope(self) -> float:
        """The length of the loss's gradient."""
        sums, head = np.zeros(len(self.terms)), 0.0
        for rows, t in self.rows.blocks(np.arange(len(self.rows))):
            x = t.weighted(self.squares.take(t.at))
            z = t.sums(self.terms.take(t.at) * x).sum(axis=1) + self.intercept
            rate = self.weights[rows] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - self.rows.y[rows])
            head += rate.sum()
            np.add.at(sums, t.at, t.of(rate) * x)
        sums *= self.rarity
        sums += self.penalty * self.terms / self.rarity
        return math.sqrt(head**2 + sums @ sums)


def _risen(z: float, norm: float, short: float, weight: float) -> float:
    """The log odds t of a row at which (t - z) / norm + short + weight * chance(t) is 0: z is what they are now, and norm their change by the row's share."""
    t, low, high = z, -math.inf, math.inf
    for _ in range(50):
        p = _chance(t)
        over = (t - z) / norm + short + weight * p
        # The left side rises by 1 / norm at least.
        low, high = (max(low, t - over * norm), t) if over > 0 else (t, min(high, t - over * norm))
        new = t - over / (1 / norm + weight * p * (1 - p))
        if not low <= new <= high:
            new = (low + high) / 2
        if abs(new - t) <= 1e-3 * abs(new - z):
            return new
        t = new
    return t


def _fits(folder: str, parts: list[str], shared, weights: np.ndarray, classes: np.ndarray, penalty: float, max_iter: int):
    """Per fold the model of the rows outside it, where they have both classes."""

    def run(batches):
        for b in batches:
            for m in b.column("id").to_pylist():
                if classes[m] == 2:
                    with tempfile.TemporaryDirectory() as near:
                        fit = _Fit(_Rows(folder, parts, m, near), shared.value[m], weights[m], penalty, m)
                        length, passes = fit.settle(max_iter)
                    yield pa.RecordBatch.from_pylist([{"fold": m, "intercept": fit.intercept, "length": length, "passes": passes, "terms": fit.terms.astype(np.float32).tobytes()}])

    return run


def _scored(shared, fitted, keep: list[str]):
    def run(batches):
        rarity, (models, intercepts) = shared.value.ravel(), fitted.value
        places = models.shape[1]
        models = models.ravel()
        for block in _blocks(batches):
            folds, t = block.column("__fold").to_numpy(), _Terms.read(block)
            at = t.at + t.of(folds.astype(np.int64) * places)
            z = t.sums(models.take(at) * t.weighted(np.square(rarity.take(at).astype(float)))).sum(axis=1) + intercepts[folds]
            p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
            yield pa.RecordBatch.from_arrays([*[block.column(x) for x in keep], pa.array(p)], names=[*keep, "prob_raw"])

    return run
