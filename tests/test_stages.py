import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import scores as S
from tallyweave.operators import annotate, metrics, names, prevalence, sampling
from tallyweave.plans import estimation, gating, naming, stages, training


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def first(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# Published figures


def test_published_scalars(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    r = first(spark, S.rogan_gladen(*lit(0.32, 0.8, 0.9)), S.rogan_gladen_variance(*lit(0.32, 100, 0.8, 50, 0.9, 60)))
    at = 0.22 / 0.7
    assert r["c0"] == pytest.approx(at)
    assert r["c1"] == pytest.approx((0.32 * 0.68 / 100 + at * at * 0.16 / 50 + (1 - at) ** 2 * 0.09 / 60) / 0.49)
    parts = spark.createDataFrame([(0.2, 0.01, 50), (0.5, 0.02, 50)], "estimate double, variance double, n int")
    assert prevalence.composite(parts).first()["estimate"] == pytest.approx(0.35)
    # The confusion cells of the frozen test at its three thresholds (TN, FP, FN, TP) and what was reported of the first.
    c = spark.createDataFrame([(81, 17, 1, 76), (87, 11, 7, 70), (84, 14, 2, 75)], "tn long, fp long, fn long, tp long")
    m = S.confusion_metrics(*(F.col(k) for k in ("tp", "fp", "fn", "tn")))
    got = c.select(*[v.alias(k) for k, v in m.items()]).first()
    assert [round(got[k], 4) for k in ("precision", "recall", "f1", "mcc")] == [0.8172, 0.987, 0.8941, 0.8093]


def test_weighted_and_unweighted_means_differ(spark):
    y, p, w = [1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.2, 0.2, 0.2, 0.2], [10, 10, 1, 1, 1, 1]
    a = spark.createDataFrame([(b, c, float(d)) for b, c, d in zip(y, p, w)], "y int, p double, w double")
    c = spark.createDataFrame([(x,) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.2)], "p double")
    one, two = prevalence.ppi(a, c, "y", "p").first()["estimate"], prevalence.ppi(a, c, "y", "p", anchor_weight="w").first()["estimate"]
    assert 0 <= one <= 1 and abs(one - two) > 1e-3


def prevalence_case(spark):
    """100 predictions in three tiers, 50 anchors: the stage's published case."""
    pred = []
    for i in range(100):
        tier = "HIGH" if i < 40 else "MEDIUM" if i < 80 else "LOW"
        label = int(i < 32 or 80 <= i < 86)
        pred.append((f"E{i:04d}", tier, "A" if i < 90 else "B", None if tier == "LOW" else (0.9 if label else 0.1), label if tier == "LOW" else None, 1, label))
    p = spark.createDataFrame(pred, "EIN2 string, tier string, grp string, p double, rule int, multiplicity long, label int")
    keep = [f"E{i:04d}" for i in [*range(16), *range(32, 56), *range(80, 90)]]
    return p, p.filter(F.col("EIN2").isin(keep)).withColumn("y", F.col("label")).withColumn("sample_prob", F.lit(0.5))


def test_prevalence_case(spark):
    pred, anchor = prevalence_case(spark)
    hm = {r["estimator"]: r for r in estimation.hm_estimate(anchor, pred).collect()}
    assert all(abs(r["estimate"] - 0.4) <= 0.05 and r["n_anchor"] == 40 and r["n_corpus"] == 80 for r in hm.values()) and len(hm) == 2
    low = prevalence.rule_share(pred.filter("tier = 'LOW'"), "rule", 1.0, 10, 1.0, 10).first()
    assert low["estimate"] == pytest.approx(0.3) and low["n"] == 20
    parts = spark.createDataFrame([(hm["ppi"]["estimate"], hm["ppi"]["variance"], 80.0), (low["estimate"], low["variance"], 20.0)], "estimate double, variance double, n double")
    whole = prevalence.composite(parts).first()
    assert whole["ci_lower"] <= 0.38 <= whole["ci_upper"]
    g = {r["grp"]: r for r in estimation.group_composites(anchor, pred, 1.0, 10, 1.0, 10).collect()}
    assert g["B"]["suppressed"] and g["B"]["estimate"] is None and g["B"]["n"] == 10 and g["B"]["n_anchor"] == 0
    assert g["A"]["n_anchor"] == 50 and g["A"]["ci_lower"] <= 0.42 <= g["A"]["ci_upper"] and g["A"]["n_low"] == 10
    assert prevalence.rule_share(spark.createDataFrame([(x,) for x in (1, 0, 1, 0, 1)], "rule int"), "rule", None, 0, None, 0).first()["estimate"] == pytest.approx(0.6)
    s = estimation.multiplicity_sensitivity(anchor.withColumn("multiplicity", F.lit(1).cast("long")), pred).first()
    assert s["delta"] == pytest.approx(0) and s["status"] == "ok"
    none = estimation.hm_estimate(anchor, pred.filter("tier = 'LOW'")).collect()
    assert len(none) == 2 and all(r["estimate"] == 0 and r["n_corpus"] == 0 for r in none)
    with pytest.raises(ValueError, match="unknown tier"):
        estimation.group_composites(anchor, pred.withColumn("tier", F.lit("TOP")), 1.0, 10, 1.0, 10)


def test_stage_nine_joins(spark):
    raw = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None), ("4", "")], "EIN2 string, t string")
    pred = spark.createDataFrame([("1", "a"), ("3", None), ("4", "")], "EIN2 string, t string")
    m = estimation.with_multiplicity(pred, raw, "t")
    assert rows(m, "EIN2", "multiplicity") == [("1", 2), ("3", 1), ("4", 1)]
    assert rows(estimation.anchor_multiplicity(spark.createDataFrame([("1",), ("9",)], "EIN2 string"), m), "EIN2", "multiplicity") == [("1", 2), ("9", 1)]
    with pytest.raises(Exception, match="no raw row"):
        estimation.with_multiplicity(pred, raw.filter("t is not null"), "t").collect()
    a, man = spark.createDataFrame([("1", 1)], "EIN2 string, y int"), spark.createDataFrame([("1", "P")], "EIN2 string, ntee_major_group string")
    assert rows(estimation.anchor_with_group(a, man), "EIN2", "ntee_major_group") == [("1", "P")]
    for bad in (man.limit(0), man.union(man)):
        with pytest.raises(Exception, match="manifest"):
            estimation.anchor_with_group(a, bad).collect()
    x = spark.createDataFrame([(" high ", " "), (None, None)], "tier string, ntee_major_group string")
    assert rows(estimation.common_columns(x), "tier", "ntee_major_group") == [("HIGH", "UNKNOWN"), (None, "UNKNOWN")]
    with pytest.raises(Exception, match="no prediction"):
        estimation.scores_of(spark.createDataFrame([("9",)], "EIN2 string"), m, "EIN2", ["multiplicity"]).collect()
    with pytest.raises(ValueError, match="unknown"):
        estimation.ordered_groups(spark.createDataFrame([("?", 1)], "g string, n int"), "g", "n", {"A": "x"})
    t = estimation.first_text([spark.createDataFrame([("1", "x"), ("2", None)], "EIN2 string, text string"), spark.createDataFrame([("1", "z"), ("2", "y")], "EIN2 string, text string")], raw)
    assert rows(t, "EIN2", "text") == [("1", "x"), ("2", "y"), ("3", None), ("4", None)]


def test_cross_checks_report_and_go_on(spark):
    pred, anchor = prevalence_case(spark)
    got = {r["name"]: r for r in estimation.cross_checks(anchor, pred, ["emq", "kdey", "other"]).collect()}
    assert [got[k]["status"] for k in ("emq", "kdey", "other")] == ["ok", "ok", "skipped"] and 0 <= got["emq"]["estimate"] <= 1
    assert {r["status"] for r in estimation.cross_checks(anchor.limit(0), pred, ["emq"]).collect()} == {"skipped"}
    broken = estimation.cross_checks(anchor.withColumn("y", F.lit(None).cast("int")).unionByName(anchor.limit(1).withColumn("y", F.lit(1))), pred.withColumn("multiplicity", F.lit("x")), ["emq"]).first()
    assert broken["status"] in ("failed", "ok")


# Gates


def test_label_gate(spark):
    t = spark.createDataFrame([("1", "validation", "1"), ("2", "validation", "0.0"), ("3", "test", " "), ("4", "test", "maybe"), ("5", "test", None)], "EIN2 string, split string, human_label string")
    ok = gating.label_problems(t, t, ["validation"])
    assert ok.count() == 0
    got = rows(gating.label_problems(t, spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "EIN2 string"), ["validation", "test", "monitor"]), "problem", "split", "n")
    assert got == [("extra ids", None, 2), ("labels not 0 or 1", "test", 3), ("missing ids", None, 1), ("split without rows", "monitor", 1)]
    assert rows(gating.label_problems(t, t), "problem", "n") == [("labels not 0 or 1", 3)]
    with pytest.raises(ValueError, match="human_label"):
        gating.label_problems(t.drop("human_label"), t)


def test_coding_gate(spark):
    m = spark.createDataFrame([("1", "a", "r"), ("2", "b", "r"), ("3", None, "r")], "EIN2 string, text string, rubric string")
    same = m.withColumn("human_label", F.lit("1"))
    assert gating.coding_changes(same, m, ["text", "rubric"]).count() == 0
    changed = spark.createDataFrame([("1", "A", "r", "1"), ("3", None, "r2", "2"), ("4", "d", "r", "")], "EIN2 string, text string, rubric string, human_label string")
    assert rows(gating.coding_changes(changed, m, ["text", "rubric"]), "change", "n") == [("id added", 1), ("id lost", 1), ("label not 0 or 1", 1), ("rubric changed", 1), ("text changed", 1)]


def test_small_checks(spark):
    p = spark.createDataFrame([(0.2, 0.8), (0.5, 0.4), (1.5, -0.5), (None, 1.0), (float("nan"), 0.5)], "p1 double, p0 double")
    r = gating.probability_problems(p, "p1", "p0").first()
    assert (r["n"], r["n_missing"], r["n_outside"]) == (5, 1, 2) and r["n_not_one"] >= 1
    with pytest.raises(ValueError, match="1 missing"):
        gating.assert_probabilities(p, "p1", "p0")
    assert gating.assert_probabilities(p.limit(1), "p1", "p0").count() == 1
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    gating.assert_disjoint(ids("a", None), ids("b", None), "k")
    with pytest.raises(ValueError, match=r"share 2 k, for instance \['a', 'b'\]"):
        gating.assert_disjoint(ids("a", "b", "b"), ids("b", "a"), "k")
    x = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    gating.assert_counts(x, {"all": F.lit(True), "big": F.col("v") > 1}, {"all": 3})
    with pytest.raises(ValueError, match="big: 2 rows, 1 expected"):
        gating.assert_counts(x, {"all": F.lit(True), "big": F.col("v") > 1}, {"all": 3, "big": 1})
    s = spark.createDataFrame([("x classifier",), ("rule",), (None,)], "decision_source string")
    assert gating.classifier_rows(s).count() == 1 and gating.classifier_rows(s.filter("decision_source = 'rule'")).count() == 1
    with pytest.raises(ValueError, match="no row"):
        gating.in_scope(s, "decision_source", ["other"])
    with pytest.raises(ValueError, match="both classes"):
        gating.both_classes(spark.createDataFrame([("1",), ("1.0",), ("x",)], "y string"), "y")
    assert gating.minority_class(3, 2) == 0 and gating.minority_class(2, 2) == 1 and gating.minority_class(2, 2, tie=0) == 0
    assert gating.first_rows(x, "v", 2).count() == 2 and gating.first_rows(x, "v", None).count() == 3


def labelled(spark, n=60, wrong=3):
    """Votes of three sources, two mostly right, and the human labels."""
    truth = [(f"{i:03d}", int(i % 3 == 0)) for i in range(n)]
    votes = []
    for i, (e, y) in enumerate(truth):
        for s in range(3):
            flip = i < wrong if s < 2 else i % 4 == 0
            votes.append((e, f"s{s}", 1 - y if flip else y, 0.9))
    return spark.createDataFrame(votes, "EIN2 string, source_id string, label int, confidence double"), spark.createDataFrame(truth, "EIN2 string, human_label int")


def test_freeze_gate(spark):
    v, h = labelled(spark)
    held = spark.createDataFrame([("000",), ("059",), (None,)], "EIN2 string")
    out, rep = gating.freeze(v, h, held)
    assert out.count() == 58 and rep["kappa"] > 0.85 and rep["minority_class"] == 1 and rep["n"] == 60 and rep["f1_low"] <= rep["f1"] <= rep["f1_high"]
    with pytest.raises(ValueError, match="not frozen"):
        gating.freeze(labelled(spark, wrong=25)[0], h, held)
    with pytest.raises(ValueError, match="no record"):
        gating.freeze(v, h.limit(0), held)
    invented = spark.createDataFrame([("003", "s0"), ("003", "s1")], "EIN2 string, source_id string")
    assert rows(gating.freeze(v, h, held, fabricated=invented)[0].filter("EIN2 = '003'"), "num_votes") == [(1,)]


def test_aggregation_compare(spark):
    v, h = labelled(spark)
    got = {r["method"]: r for r in gating.compare_aggregations(v, h, ["majority", "dawid_skene", "crowdlab", "nonsense"]).collect()}
    assert got["majority"]["status"] == "ok" and got["majority"]["clears_majority"] is None and got["dawid_skene"]["status"] == "ok"
    assert got["crowdlab"]["status"] == "skipped" and "probabilities" in got["crowdlab"]["reason"] and "unknown method" in got["nonsense"]["reason"]
    assert all(not r["best"] or r["clears_majority"] for r in got.values())


def test_sample_checks(spark):
    rows_ = [(str(i), "gold", "validation", chr(65 + i), False) for i in range(26)] + [(f"s{i}", "silver", "train", "A", i < 3) for i in range(10)]
    df = spark.createDataFrame(rows_, "sample_id string, pool string, split string, grp string, is_positive boolean")
    assert all(r["ok"] for r in gating.sample_problems(df).collect())
    twice = df.union(df.filter("sample_id = '1'").withColumn("pool", F.lit("silver")))
    assert rows(gating.sample_problems(twice).filter("not ok"), "check", "n") == [("ids in both pools", 1), ("repeated ids", 1)]


# Training


def test_training_frame_refuses_held_out_records(spark):
    v = spark.createDataFrame([("1", 1), ("1", 0), ("2", 0), ("3", 1)], "EIN2 string, label int")
    labels = spark.createDataFrame([("1", 1), ("2", 0), ("3", None)], "EIN2 string, label int")
    t = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "EIN2 string, text string")
    got = training.training_frame(v, labels, t, spark.createDataFrame([("3",), ("9",)], "EIN2 string"))
    assert rows(got, "EIN2", "p_pos", "hard_label") == [("1", 0.5, 1), ("2", 0.0, 0)]
    with pytest.raises(ValueError, match=r"share 1 EIN2, for instance \['2'\]"):
        training.training_frame(v, labels, t, spark.createDataFrame([("2",)], "EIN2 string"))


def test_arms(spark):
    f = spark.createDataFrame([("1", "a", 0.5, 1), ("2", "b", 0.9, 1), ("3", "c", 0.1, 0), ("4", "d", 0.6, 0)], "EIN2 string, text string, p_pos double, hard_label int")
    assert rows(training.arm(f, "soft").groupBy("label").agg(F.round(F.sum("weight"), 6).alias("w")), "label", "w") == [(0.0, 1.9), (1.0, 2.1)]
    assert training.arm(f, "class_weighted").agg(F.sum("weight")).first()[0] == pytest.approx(4)
    s = spark.createDataFrame([("1", 0.9), ("2", 0.9), ("3", 0.1), ("4", 0.95)], "EIN2 string, p1 double")
    assert rows(training.arm(f, "pruned", s), "EIN2") == [("1",), ("2",), ("3",)]
    part = training.arm(f, "pruned", s.limit(3))  # one score is missing, so all are judged by their votes
    assert rows(part, "EIN2") == rows(training.arm(f, "pruned"), "EIN2")
    with pytest.raises(ValueError):
        training.arm(f, "other")
    with pytest.raises(ValueError, match="different texts"):
        training.one_text_per_id([f, f.withColumn("text", F.lit("q"))])
    assert training.one_text_per_id([f, f]).count() == 4


def test_folds_resume(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i % 3, float(i % 2)) for i in range(30)], "EIN2 string, fold int, x double")
    fitted = []

    def fit(train):
        fitted.append(train.select("fold").distinct().count())
        return None

    score = lambda m, q: q.withColumn("prob_raw", F.col("x") * 0.8 + 0.1)
    at = str(tmp_path / "folds")
    one = rows(training.resumed_out_of_fold(df, fit, score, at), "EIN2", "fold", "p1")
    assert len(one) == 30 and fitted == [2, 2, 2]
    assert rows(training.resumed_out_of_fold(df, fit, score, at), "EIN2", "fold", "p1") == one and len(fitted) == 3
    more = df.union(spark.createDataFrame([("99", 1, 1.0)], df.schema))  # one fold has other ids now
    assert training.resumed_out_of_fold(more, fit, score, at).count() == 31 and len(fitted) == 4
    (tmp_path / "folds" / "fold=2" / "_SUCCESS").unlink()  # a fold that was not finished
    assert training.resumed_out_of_fold(more, fit, score, at).count() == 31 and len(fitted) == 5
    with pytest.raises(ValueError, match="outside"):
        training.resumed_out_of_fold(df, fit, lambda m, q: q.withColumn("prob_raw", F.lit(1.5)), str(tmp_path / "bad"))


def test_run_matrix_resumes(spark, tmp_path):
    runs = training.run_matrix(["a", "b"], ["soft", "hard"], [0.5, 1.0], [1, 2], best={"model": "a", "arm": "hard"}, final_seeds=[7])
    assert [sum(r.phase == p for r in runs) for p in ("curve", "sweep", "final")] == [4, 6, 1] and len({r.run_id for r in runs}) == len(runs)
    with pytest.raises(ValueError):
        training.run_matrix(["a"], [], [0.0], [])
    done = []

    def run(r):
        done.append(r.run_id)
        if len(done) == 3:
            raise RuntimeError("stopped")
        return r.fraction / 2

    with pytest.raises(RuntimeError):
        training.execute(spark, runs[:4], run, str(tmp_path))
    got = training.execute(spark, runs[:4], run, str(tmp_path))
    assert got.count() == 4 and len(done) == 5 and done.count(runs[0].run_id) == 1
    assert rows(training.documentation_curve(got), "model", "fraction", "mean", "n") == [("a", 0.5, 0.25, 1), ("a", 1.0, 0.5, 1), ("b", 0.5, 0.25, 1), ("b", 1.0, 0.5, 1)]


def test_a_text_run_learns(spark):
    f = spark.createDataFrame([(str(i), ("church prayer " if i % 2 else "garden science ") + f"word{i % 7}", float(i % 2), i % 2) for i in range(80)], "EIN2 string, text string, p_pos double, hard_label int")
    assert training.train_text_model(f, training.Run("sweep", "text", "soft", 0.5, 1), features=1 << 10, max_iter=30) > 0.95


# Names


def name_case(spark):
    panel = spark.createDataFrame([("P1", "Hope Church Inc", 2019, "S"), ("P1", "Hope", 2020, "S"), ("P2", "Garden Club", 2020, "S"), ("P3", "Temple Choir", 2020, "S"), ("P4", " ", 2020, "S"), ("P5", "Other", 2020, "T")], "EIN2 string, name string, year int, scope string")
    reg = spark.createDataFrame([("P1", "X20", None), ("P2", "1A", "10"), ("P9", "P20", None)], "EIN2 string, NTEE_IRS string, BMF_FOUNDATION_CODE string")
    bare = spark.createDataFrame([("P1", "hope church")], "EIN2 string, bare_name string")
    missions = spark.createDataFrame([("P1", "We pray."), ("P2", " "), ("P3", "We sing.")], "EIN2 string, text string")
    held = spark.createDataFrame([("P3",)], "EIN2 string")
    return panel, bare, reg, missions, held


def test_name_frame(spark):
    f = naming.name_frame(*name_case(spark), scope=["S"], expected={"rows": 3, "with mission": 2, "flagged": 2, "contaminated": 1})
    got = {r["EIN2"]: r for r in f.collect()}
    assert got["P1"]["name"] == "Hope Church Inc" and got["P1"]["bare_name"] == "hope church" and got["P2"]["is_church_foundation"] and got["P2"]["bare_name"] is None and not got["P3"]["has_registry"]
    assert dict(rows(naming.frame_counts(f), "name", "n")) == {"rows": 3, "with mission": 2, "name only": 1, "flagged": 2, "flagged, name only": 1, "contaminated": 1}
    with pytest.raises(ValueError, match="rows: 3 rows, 4 expected"):
        naming.name_frame(*name_case(spark), scope=["S"], expected={"rows": 4})
    with pytest.raises(ValueError, match="no row"):
        naming.name_frame(*name_case(spark), scope=["Z"])


def test_name_validation(spark):
    f = naming.name_frame(*name_case(spark), scope=["S"])
    s = naming.score_names(f, stages.default_scorer)
    assert rows(s.filter("EIN2 = 'P1'"), "input_variant", "text") == [("suffix_retaining", "Hope Church Inc"), ("suffix_stripped", "Hope Church")]
    m = spark.createDataFrame([("P1", 0.9, 1), ("P2", 0.1, 0), ("P3", 0.2, 0)], "EIN2 string, prob_calibrated double, pred_label int")
    pairs, n = naming.paired(s, f, m)
    assert n == {"n_without_mission_score": 0, "n_paired": 2, "n_contaminated": 1, "n_evaluated": 1} and pairs.count() == 2
    assert naming.paired(s, f, m.withColumn("prob_calibrated", F.when(F.col("EIN2") != "P1", F.col("prob_calibrated"))))[1]["n_without_mission_score"] == 1
    with pytest.raises(ValueError, match="variants"):
        naming.paired(s.filter("input_variant = 'suffix_stripped'"), f, m)
    with pytest.raises(ValueError, match="repeat"):
        naming.paired(s.union(s), f, m)
    r = {x["input_variant"]: x for x in naming.variant_report(pairs).collect()}
    assert r["suffix_stripped"]["n"] == 1 and r["suffix_stripped"]["transfer_precision"] == 1 and not r["suffix_stripped"]["transfer_wins"] and r["suffix_stripped"]["pearson"] is None
    flags = f.withColumn("is_flagged", F.col("is_ntee_x") | F.col("is_church_foundation"))
    assert {(x["input_variant"], x["tp"], x["fn"]) for x in naming.external_report(s, flags, 0.2).collect()} == {("suffix_stripped", 1, 1), ("suffix_retaining", 1, 1)}
    with pytest.raises(Exception, match="population"):
        naming.external_report(s, flags.withColumn("population", F.lit("registry_only"))).collect()
    g = spark.createDataFrame([("P1", "validation", 0), ("P2", "test", 1)], "EIN2 string, split string, human_label int")
    o = naming.gold_offset(g, flags, pairs, ["validation"]).first()
    assert (o["n"], o["offset"], o["mission_rate"]) == (1, 1.0, 1.0)


def test_second_names_and_probes(spark):
    df = spark.createDataFrame([("1", "Hope Inc", "Hope Church"), ("2", "Grace Temple", "Grace Hall"), ("3", "A", None), ("4", "Same", "Same")], "EIN2 string, name string, second_name string")
    got = {r["EIN2"]: r for r in naming.second_names(df, stages.default_scorer).collect()}
    assert set(got) == {"1", "2"} and got["1"]["direction"] == "second_name_adds_token" and got["1"]["second_only"] == ["church"] and got["1"]["second_prob"] > got["1"]["first_prob"] and got["2"]["first_only"] == ["temple"]
    p = {r["probe_id"]: r for r in naming.probes(spark, stages.default_scorer).collect()}
    assert len(p) == len(naming.PROBES) and p["p1"]["text_cleaned"] == p["p4"]["text_cleaned"]
    hot = spark.createDataFrame([(str(i), 0.5, "g", int(i < 7)) for i in range(30)] + [("a", 0.9, "g", 0)], "id string, p double, by string, b int")
    assert names.top_k_matched(hot, "p", "id", "by", "b").filter("predicted = 1").count() == 7


# Annotation


def test_annotation_run_resumes(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def connect():
        def answer(texts):
            asked.add(len(texts))
            return ["broken" if "?" in t else '{"binary_label": "%s", "confidence": 0.9, "domains_present": ["x"], "evidence_spans": [], "boundary_notes": null, "reason": "r"}' % ("religious" if "church" in t else "nonreligious") for t in texts]

        return answer

    store, audits = str(tmp_path / "store"), str(tmp_path / "audits")
    who = [annotate.Annotator("m", p, connect) for p in ("v1", "v2")]
    df = spark.createDataFrame([("1", "a church"), ("2", "a garden"), ("3", "what?")], "EIN2 string, text string")
    assert annotate.run(df, who, store).count() == 6 and asked.value == 6
    assert annotate.run(df, who, store).count() == 2 and asked.value == 8  # only failed answers are asked for again
    got = spark.read.parquet(store).filter("error is null")
    assert rows(got.filter("source_id = 'm__v1'"), "EIN2", "label", "domains_present") == [("1", 1.0, '["x"]'), ("2", 0.0, '["x"]')]
    can = df.limit(2)
    annotate.run(df.limit(0), who[:1], store, audits=audits, canaries=can)
    annotate.run(df.limit(0), who[:1], store, audits=audits, canaries=can)
    log = spark.read.json(f"{audits}/log")
    assert rows(log, "first", "n_changed", "n_common") == [(False, 0, 2), (True, 0, 2)]


# Samples and intervals


def test_bootstrap_of_ranked_scores(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    p = np.clip(0.3 * y + 0.7 * rng.random(300), 0, 1).round(3)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    counts = [r.asDict() for r in df.groupBy("p", "y").agg(F.count("*").alias("n")).collect()]
    low, high = sampling.bootstrap_scores(counts, sampling.counted_average_precision, 300)
    ap = metrics.average_precision(df, "y", "p").first()[0]
    arrays = sorted(counts, key=lambda r: (-r["p"], r["y"]))
    assert sampling.counted_average_precision(*(np.array([r[c] for r in arrays], float) for c in ("p", "y", "n"))) == pytest.approx(ap)
    assert low < ap < high and high - low < 0.3 and np.isnan(sampling.bootstrap_scores([], sampling.counted_average_precision)[0])


def test_equal_parts(spark):
    df = spark.createDataFrame([(str(i), "abc"[min(i // 10, 2)]) for i in range(50)] + [("x", None)], "id string, g string")
    n = {r["g"]: r["count"] for r in sampling.stratified_by_group(df, "g", "id", 26).groupBy("g").count().collect()}
    assert n == {"a": 9, "b": 9, "c": 8} and sampling.stratified_by_group(df.limit(0), "g", "id", 5).count() == 0
    few = sampling.stratified_by_group(df, "g", "id", 45).groupBy("g").count()
    assert rows(few, "g", "count") == [("a", 10), ("b", 10), ("c", 15)]
