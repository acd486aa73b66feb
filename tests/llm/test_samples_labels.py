import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import consensus, ledger, proportions

SAMPLE = "EIN2 string, load_batch int"


def test_ledger_keeps_members(spark, tmp_path):
    rows = [(f"{i:09d}", 1 + i % 4) for i in range(400)] + [("EIN-00-0000001", 3), (None, 1), ("123", None), ("bad", 1)]
    df = spark.createDataFrame(rows, SAMPLE)
    one = sorted(map(tuple, ledger.replay(df, "EIN2", "load_batch").collect()))
    assert one == sorted(map(tuple, ledger.replay(df.repartition(11), "EIN2", "load_batch").collect()))
    path = str(tmp_path / "ledger")
    early = {r["key"] for r in ledger.replay(df.filter("load_batch <= 2 or load_batch is null"), "EIN2", "load_batch", path).collect()}
    late = {r["key"] for r in ledger.replay(df, "EIN2", "load_batch", path).collect()}
    assert early < late and late == {k for k, _, _ in one} and len(late) == 40
    assert {r["key"] for r in ledger.replay(df, "EIN2", "load_batch", path).collect()} == late
    gone = df.filter(~F.col("EIN2").isin([k.replace("EIN-", "").replace("-", "") for k in early]))
    assert early <= {r["key"] for r in ledger.replay(gone, "EIN2", "load_batch", path).collect()}
    assert ledger.replay(df.limit(0), "EIN2", "load_batch").count() == 0


def test_one_pass_draws_as_many_steps_do(spark, tmp_path):
    rows = [(f"{i:09d}", 1 + (i * 7919) % 5) for i in range(900)]
    df = spark.createDataFrame(rows, SAMPLE)
    keys = df.select(ledger.standard_ein("EIN2").alias("key"), "load_batch")
    held = None
    for g in range(1, 6):
        new = ledger.grow(held, keys.filter(F.col("load_batch") <= g).select("key"), g).collect()
        held = spark.createDataFrame([*(held.collect() if held else []), *new], ledger.LEDGER)
    assert sorted(map(tuple, ledger.replay(df, "EIN2", "load_batch").collect())) == sorted(map(tuple, held.collect()))


def test_a_ledger_that_cannot_be_read_is_an_error(spark, tmp_path):
    bad = tmp_path / "ledger"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        ledger.replay(spark.createDataFrame([("1", 1)], SAMPLE), "EIN2", "load_batch", str(bad))


def test_lowest_is_exact(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"), (F.col("id") % 50 * 20_000_000_000_000_000).alias("priority"))
    want = sorted((r["priority"], r["key"]) for r in keys.collect())
    for k in (0, 1, 9, 10, 11, 499, 500, 900):
        assert sorted((r["priority"], r["key"]) for r in ledger.lowest(keys, k, 64).collect()) == want[:k]


TARGET = "target_id long, draw_id int, ntee_major_group string, tier string, target_share double, min_rows int, draw_size long"


def cells(spark, rows):
    return proportions.units(spark.createDataFrame(rows, "EIN2 string, ntee_major_group string, tier string"))


def test_draw_matches_targets(spark):
    rows = [(f"{i:09d}", " a", "High") for i in range(900)] + [(f"{i:09d}", "B", "low ") for i in range(900, 1000)] + [("EIN-00-0000001", "A", "HIGH"), (None, "A", "HIGH"), ("7", None, "HIGH"), ("8", "C", "LOW")]
    frame = cells(spark, rows)
    targets = spark.createDataFrame([(1, 1, "A", "HIGH", 0.7, 1, 101), (2, 1, "B", "LOW", 0.28, 1, 101), (3, 1, "C", "LOW", 0.02, 3, 101), (4, 2, "B", "LOW", 0.001, 9, 50), (5, 2, "A", "HIGH", 0.999, 1, 50)], TARGET)
    s = proportions.draw(frame, targets)
    n = {(r["draw_id"], r["cell_group"]): r["count"] for r in s.groupBy("draw_id", "cell_group").count().collect()}
    assert abs(n[1, "A"] - 70.7) < 1 and abs(n[1, "B"] - 28.28) < 1 and n[1, "C"] == 1 and n[2, "B"] == 9 and abs(n[2, "A"] - 49.95) < 1
    assert s.groupBy("draw_id", "ein", "cell_group").count().filter("count > 1").count() == 0
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, proportions.draw(frame.repartition(9), targets).collect()))
    rep = {r["target_id"]: r for r in proportions.report(frame, targets, s).collect()}
    assert not rep[3]["met"] and rep[3]["need"] == 3 and rep[3]["drawn"] == 1 and rep[1]["met"] and rep[1]["available"] == 900
    assert {r["target_id"] for r in rep.values() if not r["met"]} == {3}
    probs = {(r["draw_id"], r["cell_group"]): r["inclusion_prob"] for r in s.collect()}
    assert probs[2, "B"] == pytest.approx(9 / 100) and probs[1, "C"] == 1  # a repaired cell has its floor's probability
    assert proportions.draw(frame.limit(0), targets).count() == 0 and proportions.draw(frame, targets.limit(0)).count() == 0
    assert proportions.report(frame.limit(0), targets, proportions.draw(frame.limit(0), targets)).filter("not met").count() == 5


def test_inclusion_probabilities(spark):
    frame = cells(spark, [(f"{i:09d}", "A", "LOW") for i in range(40)])
    targets = spark.createDataFrame([(1, 1, "A", "LOW", 1.0, 0, 10)], TARGET)
    hits = np.zeros(40)
    for seed in range(40):
        got = proportions.draw(frame, targets, seed).collect()
        assert len(got) == 10
        for r in got:
            hits[int(r["ein"])] += 1
    assert hits.min() >= 2 and hits.max() <= 20


RECORD = "EIN2 string, model_id string, prompt_id string, binary_label string, error string, text string, label double"


def record(e, m, word, error=None):
    return (e, m, "v1", word, error, "x", 9.0)


def test_consensus_with_biased_annotators(spark):
    rng = np.random.default_rng(3)
    rates = {"good": (0.92, 0.06), "fair": (0.8, 0.15), "eager": (0.95, 0.5), "wrong": (0.15, 0.85), "noise": (0.5, 0.5)}
    truth, rows = {}, []
    for i in range(600):
        e = f"{i:09d}"
        truth[f"EIN-{e[:2]}-{e[2:]}"] = z = int(rng.random() < 0.3)
        for m, (t, f) in rates.items():
            if rng.random() < 0.9:
                rows.append(record(e, m, "Religious." if rng.random() < (t if z else f) else "non-religious"))
    rows += rows[:200]  # delivered twice
    rows += [record("999999999", "good", "religious")] * 900 + [record("999999999", "fair", "nonreligious")] * 10
    rows += [record("555555555", "good", None), record("555555555", "fair", "ambiguous_review"), record("444444444", "good", "religious", "timeout"), record(None, "good", "religious")]
    df = spark.createDataFrame(rows, RECORD)
    c = consensus.consensus(df)
    got = {r["EIN2"]: r for r in c.labels.collect()}
    assert np.mean([got[e]["label"] == z for e, z in truth.items() if e in got]) > 0.93
    assert "EIN-55-5555555" not in got and "EIN-44-4444444" not in got and got["EIN-99-9999999"]["n_votes"] == 2
    rel = {r["annotator"]: r for r in c.annotators.collect()}
    assert rel["good__v1"]["reliability"] > rel["fair__v1"]["reliability"] > rel["noise__v1"]["reliability"] > rel["wrong__v1"]["reliability"]
    assert rel["wrong__v1"]["skill"] < 0 and rel["eager__v1"]["leaning"] > 0.5
    once = {r["EIN2"]: r["label"] for r in consensus.consensus(df.dropDuplicates()).labels.collect()}
    assert once == {e: r["label"] for e, r in got.items()}
    assert all(r["kappa"] is None or r["kappa"] <= 1 for r in got.values())


def test_consensus_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], RECORD)
    c = consensus.consensus(empty)
    assert c.labels.count() == 0 and c.annotators.count() == 0
    one = consensus.consensus(spark.createDataFrame([record("1", "m", "religious")], RECORD)).labels.first()
    assert one["label"] == 1 and one["kappa"] is None and one["agreement"] == 1


def test_inner_model_against_brute_force():
    s = consensus.Settings(ease_sd=0.0)
    skill, lean = np.array([2.0, 0.5]), np.array([0.3, -1.0])
    post, ease, fit = consensus.infer(np.array([0, 1, 1]), np.array([1.0, 0.0, 1.0]), np.array([0, 2, 3]), skill, lean, 0.4, s)
    sg = lambda x: 1 / (1 + np.exp(-x))
    up, down = 0.4 * sg(2.3) * (1 - sg(-0.5)), 0.6 * sg(-1.7) * (1 - sg(-1.5))
    assert post[0] == pytest.approx(up / (up + down)) and fit[0] == pytest.approx(np.log(up + down)) and list(ease) == [1, 1]
