"""The annotation store: votes in, one label per record out, and how far to trust it."""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scores import ratio
from tallyweave.operators.relations import dedup_last, pick
from tallyweave.session import written

#: The four answers an annotator may give, and their numbers.
LABELS = {"religious": 1, "nonreligious": 0, "ambiguous_review": None, "insufficient_information": None}
REQUIRED = ("binary_label", "boundary_notes", "confidence", "domains_present", "evidence_spans", "reason")
ANSWER = "binary_label string, confidence double, domains_present array<string>, evidence_spans array<string>, boundary_notes string, reason string"


def label_number(col: Column | str) -> Column:
    """1 for religious, 0 for nonreligious, null for abstentions and words not in the list."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "religious", 1).when(c == "nonreligious", 0)


def parse_answers(df: DataFrame, raw_col: str) -> DataFrame:
    """df and ``answer`` (struct), ``label``, ``parse_error``: malformed JSON, missing keys and unknown labels are named, not raised."""
    raw = F.regexp_replace(F.trim(F.coalesce(raw_col, F.lit(""))), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")
    keys = F.json_object_keys(raw)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(keys, F.array().cast("array<string>"))))
    answer = F.from_json(raw, ANSWER)
    known = F.col("answer.binary_label").isin(*LABELS)
    out = df.withColumn("answer", answer).withColumn("__missing", missing).withColumn("__object", keys.isNotNull())
    error = (
        F.when(~F.col("__object"), F.lit("malformed JSON"))
        .when(F.size("__missing") > 0, F.concat(F.lit("missing keys: "), F.array_join("__missing", ", ")))
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("invalid label: "), F.coalesce(F.col("answer.binary_label"), F.lit("null"))))
    )
    return out.withColumn("parse_error", error).withColumn("label", F.when(F.col("parse_error").isNull(), label_number("answer.binary_label"))).drop("__missing", "__object")


def majority_vote(df: DataFrame, id_col: str, label_col: str, confidence_col: str) -> DataFrame:
    """Per record: label and confidence of the majority, votes, abstentions, agreement, tie.

    A tie has no label and no confidence; a record with abstentions only has no votes, no agreement
    and is no tie. One pass with partial sums: a record with a third of all rows is a few partial rows.
    """
    v, c = F.col(label_col), F.col(confidence_col)
    sums = df.groupBy(F.col(id_col)).agg(
        F.count_if(v == 1).alias("n1"), F.count_if(v == 0).alias("n0"), F.count_if(v.isNull()).alias("num_abstain"),
        F.avg(F.when(v == 1, c)).alias("c1"), F.avg(F.when(v == 0, c)).alias("c0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    votes, tie = n1 + n0, (n1 == n0) & (n1 > 0)
    return sums.select(
        id_col, F.when(n1 > n0, 1).when(n0 > n1, 0).alias("label"), F.when(n1 > n0, F.col("c1")).when(n0 > n1, F.col("c0")).alias("confidence"),
        votes.alias("num_votes"), "num_abstain", F.when(votes > 0, F.greatest(n1, n0) / votes).alias("agreement"), tie.alias("tie"),
    )


def vote_share(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return df.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("p_pos"), F.count("*").alias("n_votes"))


def latest_votes(df: DataFrame, id_col: str, source_col: str, time_col: str, *ties: str) -> DataFrame:
    return dedup_last(df, [id_col, source_col], time_col, *ties)


def sources(votes: DataFrame, source_col: str) -> list[str]:
    """All sources in order, for ``label_matrix``; as many as models x prompts, so the list is small."""
    return [r[0] for r in votes.select(source_col).filter(F.col(source_col).isNotNull()).distinct().orderBy(source_col).collect()]


def label_matrix(votes: DataFrame, id_col: str, source_col: str, label_col: str, sources: list[str]) -> DataFrame:
    """One column per source with its label; ``votes`` must be one row per record and source."""
    return votes.groupBy(id_col).pivot(source_col, sources).agg(F.max(label_col))


def stack(matrix: DataFrame, id_col: str) -> DataFrame:
    """The inverse of label_matrix, without the empty cells."""
    values = [c for c in matrix.columns if c != id_col]
    return matrix.unpivot([id_col], values, "source_id", "label").filter("label is not null")


def agreement_with_consensus(votes: DataFrame, consensus: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Per record the share of its votes that equal the consensus label."""
    c = consensus.select(id_col, F.col("label").alias("__c"))
    return votes.filter(F.col(label_col).isNotNull()).join(c, id_col).groupBy(id_col).agg(F.avg((F.col(label_col) == F.col("__c")).cast("double")).alias("agreement"))


def pairwise_agreement(votes: DataFrame, id_col: str, source_col: str, label_col: str) -> DataFrame:
    """Per pair of sources: records both voted on, and the share on which they agree.

    Votes are gathered per record (at most one per source), so pairs form inside a row and no join
    on a hot record is needed.
    """
    v = votes.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct(F.col(source_col).alias("s"), F.col(label_col).alias("v")))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["s"] > x["s"]), lambda y: F.struct(x["s"].alias("source_a"), y["s"].alias("source_b"), (x["v"] == y["v"]).alias("same")))))
    return v.select(F.explode(pairs).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count("*").alias("n_common"), F.avg(F.col("p.same").cast("double")).alias("agreement"))


def source_summary(votes: DataFrame, source_col: str, label_col: str) -> DataFrame:
    v = F.col(label_col)
    return votes.groupBy(source_col).agg(F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_abstain"), (F.count_if(v.isNull()) / F.count("*")).alias("abstain_rate"), F.avg(v.cast("double")).alias("positive_rate"))


def vote_histogram(majority: DataFrame) -> DataFrame:
    return majority.groupBy("num_votes").agg(F.count("*").alias("n_records"), F.count_if("tie").alias("n_tied"))


def pending(records: DataFrame, sources: DataFrame, done: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Record-source pairs that the store has no row for; the list of sources is small and never shuffles the records."""
    pairs = records.select(id_col).distinct().withColumn(source_col, F.explode(F.array(*[F.lit(r[0]) for r in sources.select(source_col).distinct().orderBy(source_col).collect()])))
    return pairs.join(done.select(id_col, source_col).distinct(), [id_col, source_col], "left_anti")


def fingerprints(df: DataFrame, source_col: str, print_col: str) -> DataFrame:
    return df.groupBy(source_col).agg(F.array_sort(F.collect_set(print_col)).alias("fingerprints"))


def drift(baseline: DataFrame, current: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row: records labelled both times, how many changed, kappa and nominal alpha."""
    a = baseline.filter(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("x"))
    b = current.filter(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("y"))
    n = a.join(b, id_col).agg(*[F.count_if((F.col("x") == i) & (F.col("y") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    from tallyweave.functions.scores import confusion_metrics

    m = confusion_metrics(F.col("n11"), F.col("n01"), F.col("n10"), F.col("n00"))
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    return n.select(total.alias("n_common"), (F.col("n01") + F.col("n10")).alias("n_changed"), F.when(total > 0, m["kappa"]).alias("kappa"), m["alpha"].alias("alpha"))


def set_hash(df: DataFrame, id_col: str, by: list[str] = ()) -> DataFrame:
    """sha256 of the sorted ids, one per line; for sets that fit one row, as audits do."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(id_col).cast("string"))), "\n"), 256).alias("set_hash"), F.count_distinct(id_col).alias("n_ids"))


def dawid_skene(votes: DataFrame, id_col: str, source_col: str, label_col: str, rounds: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """Per record the posterior of label 1 by the two-class model with one confusion matrix per source.

    ``votes`` must be one row per record and source. Records with the same votes are one pattern with a count; a round is one pass over the patterns,
    without a shuffle, and four sums per source and task are all that leaves the executors. Rounds end when no rate moves by the
    tolerance; a fit that has not settled by the last one is reported by a warning. Fewer than two records or sources raise an error.
    """
    v = votes.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col(label_col).cast("int").alias("v"))
    names = sources(v, "s")
    number = F.create_map(*[F.lit(x) for kv in enumerate(names) for x in kv[::-1]]) if names else F.lit(None)
    arrays = F.sort_array(F.collect_list(number[F.col("s")] * 2 + F.col("v"))).alias("code") if names else F.array().cast("array<int>").alias("code")
    items = written(v.groupBy("i").agg(arrays), "votes-patterns")
    if len(names) < 2 or items.limit(2).count() < 2:
        raise ValueError("at least two records and two sources are needed")
    patterns = written(items.groupBy("code").agg(F.count("*").alias("n")), "votes-counts")
    tpr, fpr, prior = None, None, 0.5
    for k in range(rounds):
        got = np.sum([np.frombuffer(r["sums"]) for r in patterns.mapInArrow(_expect(len(names), tpr, fpr, prior), "sums binary").collect()], axis=0).reshape(-1, 4)
        a, b, c, d = got[:-1].T
        new = (a + 0.01) / (b + 0.02), (c + 0.01) / (d + 0.02)
        moved = 9.0 if tpr is None else float(max(np.abs(new[0] - tpr).max(), np.abs(new[1] - fpr).max()))
        (tpr, fpr), prior = new, float(min(max(got[-1, 0] / got[-1, 1], 1e-6), 1 - 1e-6))
        if moved < tolerance:
            break
    else:
        warnings.warn(f"not settled after {rounds} rounds: a rate still moves by {moved:.1e}", stacklevel=2)
    both = F.array(*[F.lit(float(x)) for s in zip(np.log1p(-tpr) - np.log1p(-fpr), np.log(tpr) - np.log(fpr), strict=True) for x in s])
    odds = F.aggregate("code", F.lit(math.log(prior / (1 - prior))), lambda o, x: o + F.get(both, x))
    post = items.select("i", (1 / (1 + F.exp(-odds))).alias("r"))
    counts = votes.groupBy(F.col(id_col).alias("i")).agg(F.count_if(F.col(label_col).isin(0, 1)).alias("num_votes"), F.count_if(F.col(label_col).isNull()).alias("num_abstain"))
    return counts.join(post, "i", "left").select(F.col("i").alias(id_col), F.when(F.col("r") > 0.5, 1).when(F.col("r") < 0.5, 0).alias("label"), F.greatest("r", 1 - F.col("r")).alias("confidence"), F.col("r").alias("posterior"), "num_votes", "num_abstain")


def _expect(n_sources: int, tpr, fpr, prior: float):
    """Sums over patterns given the rates (the share of positive votes without any): per source votes and records weighted by both classes; last the
    mass of class 1 and the number of records."""

    def run(batches):
        out = np.zeros((n_sources + 1, 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            code, ends = batch.column("code").flatten().to_numpy(), batch.column("code").offsets.to_numpy()
            n, starts = batch.column("n").to_numpy().astype(float), ends[:-1] - ends[0]
            at, source, said = np.repeat(np.arange(len(n)), np.diff(ends)), code >> 1, (code & 1).astype(float)
            if tpr is None:
                r = np.add.reduceat(said, starts) / np.diff(ends)
            else:
                each = np.where(said > 0, np.log(tpr[source] / fpr[source]), np.log((1 - tpr[source]) / (1 - fpr[source])))
                r = 1 / (1 + np.exp(-np.clip(np.add.reduceat(each, starts) + math.log(prior / (1 - prior)), -700, 700)))
            w, q = n[at], r[at]
            for k, x in enumerate((q * said, q, (1 - q) * said, 1 - q)):
                out[:-1, k] += np.bincount(source, w * x, n_sources)
            out[-1, :2] += (n * r).sum(), n.sum()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return run


def crowdlab(votes: DataFrame, predictions: DataFrame, id_col: str, source_col: str, label_col: str, p_col: str) -> DataFrame:
    """Per record the classifier's probability and its votes, weighted by how well each predicts the others' majority.

    Weights follow the published scheme for two classes: a source's weight is one minus its error
    against the majority over the majority baseline's error, at least 0; votes count as the mean agreement
    of their source. Records without a prediction are left out.
    """
    v = votes.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col(label_col).cast("double").alias("v"))
    m = v.groupBy("i").agg(F.avg("v").alias("share"), F.count("*").alias("n")).withColumn("maj", F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0))
    p = predictions.select(F.col(id_col).alias("i"), F.col(p_col).alias("p")).filter("p is not null")
    multi = m.filter("n > 1")
    base = multi.agg(F.greatest(F.lit(1e-6), 1 - F.greatest(F.avg("maj"), 1 - F.avg("maj"))).alias("base_error"))
    rated = v.join(multi, "i").groupBy("s").agg(F.avg((F.col("v") == F.col("maj")).cast("double")).alias("acc"))
    model = multi.join(p, "i").agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("maj")).cast("double")).alias("model_acc"))
    weigh = lambda acc: F.greatest(F.lit(0.0), 1 - (1 - F.col(acc)) / F.col("base_error"))
    weights = rated.crossJoin(F.broadcast(base)).select("s", "acc", weigh("acc").alias("w"))
    wm = model.crossJoin(base).select(F.coalesce(weigh("model_acc"), F.lit(1.0)).alias("wm"))
    say = F.when(F.col("v") == 1, F.col("acc")).otherwise(1 - F.col("acc"))
    joined = v.join(F.broadcast(weights), "s").groupBy("i").agg(F.sum(F.col("w") * say).alias("wv"), F.sum("w").alias("w"))
    return joined.join(p, "i").crossJoin(F.broadcast(wm)).select(F.col("i").alias(id_col), ratio(F.col("wm") * F.col("p") + F.col("wv"), F.col("wm") + F.col("w")).alias("posterior"))


def aggregate_labels(votes: DataFrame, method: str, id_col: str, source_col: str, label_col: str, confidence_col: str, predictions: DataFrame | None = None, p_col: str = "p") -> DataFrame:
    """majority, dawid_skene or crowdlab by name."""
    if method == "majority":
        return majority_vote(votes, id_col, label_col, confidence_col)
    if method == "dawid_skene":
        return dawid_skene(votes, id_col, source_col, label_col)
    if method == "crowdlab":
        if predictions is None:
            raise NotImplementedError("crowdlab needs predicted probabilities")
        return crowdlab(votes, predictions, id_col, source_col, label_col, p_col)
    raise ValueError(f"unknown method {method!r}")


def evidence_spans(store: DataFrame, id_col: str, source_col: str, spans_col: str) -> DataFrame:
    """One row per span of the JSON lists in ``spans_col``; null, empty and malformed lists have none."""
    return store.select(id_col, source_col, F.explode(F.from_json(spans_col, "array<string>")).alias("span")).filter(F.trim("span") != "")


def verify_evidence(spans: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans with ``verbatim``: whether any text of the record contains them. Records without a text have null.

    ``texts`` may have several rows per record; the answer is aggregated per span, after a join on the
    record that AQE may split where a record is hot.
    """
    t = texts.select(id_col, F.col(text_col).alias("__t")).filter("__t is not null").distinct()
    keys = spans.columns
    found = F.max(F.expr("contains(__t, span)"))
    return spans.distinct().join(t, id_col, "left").groupBy(*keys).agg(found.alias("verbatim"))


def abstain_fabricated(store: DataFrame, fabricated: DataFrame, id_col: str, source_col: str, label_col: str) -> DataFrame:
    """The store with the label of positive rows taken away where (record, source) is among the fabricated."""
    bad = fabricated.select(id_col, source_col).distinct().withColumn("__bad", F.lit(True))
    out = store.join(bad, [id_col, source_col], "left")
    return out.withColumn(label_col, F.when((F.col(label_col) == 1) & F.col("__bad"), F.lit(None)).otherwise(F.col(label_col))).drop("__bad")


def vote_arms(votes: DataFrame, truth: DataFrame, id_col: str, source_col: str, label_col: str, truth_col: str) -> DataFrame:
    """Every source scored against human labels: records in common, abstentions, precision, recall, F1."""
    j = votes.join(truth.select(id_col, F.col(truth_col).alias("__y")), id_col)
    v, y = F.col(label_col), F.col("__y")
    n = j.groupBy(source_col).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_abstain"), F.count_if((v == 1) & (y == 1)).alias("tp"), F.count_if((v == 1) & (y == 0)).alias("fp"), F.count_if((v == 0) & (y == 1)).alias("fn"))
    return n.select(source_col, "n", (F.col("n_abstain") / F.col("n")).alias("abstain_rate"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def first_match(audit: DataFrame, key_col: str, time_col: str, *ties: str) -> DataFrame:
    """The earliest audit row per set hash: the baseline a later run is compared with."""
    return pick(audit, [key_col], [F.col(time_col).isNull(), F.col(time_col), *[F.col(t) for t in ties]])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
