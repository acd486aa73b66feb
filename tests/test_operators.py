import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import calibrate, keyness, metrics, ml, names, prevalence, relations, sampling
from tallyweave.operators import votes as V
from tallyweave.sources import io


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def votes(spark, data):
    return spark.createDataFrame(data, "EIN2 string, source_id string, label int, confidence double")


def test_majority(spark):
    v = votes(spark, [("a", "1", 1, 0.8), ("a", "2", 1, 0.6), ("a", "3", 0, 0.9), ("b", "1", 1, 0.8), ("b", "2", 0, 0.9), ("c", "1", None, None), ("c", "2", None, 0.5), (None, "1", 1, 1.0)])
    got = {r["EIN2"]: r for r in V.majority_vote(v, "EIN2", "label", "confidence").collect()}
    assert (got["a"]["label"], got["a"]["num_votes"], got["a"]["tie"]) == (1, 3, False) and got["a"]["confidence"] == pytest.approx(0.7) and got["a"]["agreement"] == pytest.approx(2 / 3)
    assert (got["b"]["label"], got["b"]["confidence"], got["b"]["tie"]) == (None, None, True)
    assert (got["c"]["num_votes"], got["c"]["num_abstain"], got["c"]["agreement"], got["c"]["tie"]) == (0, 2, None, False)
    assert got[None]["label"] == 1
    assert V.majority_vote(v.limit(0), "EIN2", "label", "confidence").count() == 0


@pytest.mark.parametrize("models", [["aspen-large", "elder-flash", "lexicon-rule"], ["later-model"]])
def test_label_matrix_has_every_source(spark, monkeypatch, models):
    from tallyweave.plans import queries as Q

    data = [(str(i), f"{m}__r4", i % 2, 0.9) for i in range(4) for m in models] + [("9", f"{models[0]}__r4", None, None)]
    monkeypatch.setattr(Q.views, "votes", lambda spark, d: votes(spark, data))
    names = sorted(f"{m}__r4" for m in models)
    m = Q.label_matrix(spark, "")
    assert m.columns == ["EIN2", *names] and {r["EIN2"]: tuple(r)[1:] for r in m.collect()} == {str(i): (i % 2,) * len(names) for i in range(4)} | {"9": (None,) * len(names)}
    assert sorted(map(tuple, Q.label_stack(spark, "").collect())) == [(n, 4, 2) for n in names]


def test_tfidf_scores_runs_the_operators_settings(spark, monkeypatch):
    from tallyweave.plans import queries as Q

    df = spark.createDataFrame([(f"{i:02d}", i % 2, f"group {i}") for i in range(30)], "EIN2 string, y int, t string")
    monkeypatch.setattr(Q.views, "evaluation", lambda spark, d: df.drop("t"))
    monkeypatch.setattr(Q, "_texts", lambda spark, d: df.drop("y"))
    asked = []
    monkeypatch.setattr(ml, "fit_tfidf", lambda *a, **k: asked.append(k))
    monkeypatch.setattr(ml, "out_of_fold", lambda x, fit, score: (fit(x), x.withColumn("prob_raw", F.lit(0.5)))[1])
    assert {r["fold"] for r in Q.tfidf_scores(spark, "").collect()} == set(range(5))
    stages = ml.tfidf_pipeline("y", **asked[0]).getStages()
    assert stages[0].getNumFeatures() == stages[2].getNumFeatures() == 1 << 18 and stages[-1].getMaxIter() == 2000


def test_tfidf_scores_fits_all_folds_together(spark, monkeypatch):
    from tallyweave.plans import queries as Q

    words = "church prays daily city feeds children with food and hope for all people".split()
    rng = np.random.default_rng(5)
    data = [(f"{i:02d}", i % 3 // 2, " ".join(rng.choice(words[i % 3 :], 7)) if i else "") for i in range(60)]
    df = spark.createDataFrame(data, "EIN2 string, y int, text string")
    x = sampling.folds(df, "y", "EIN2", 2)
    one = ml.out_of_fold(x, lambda t: ml.fit_tfidf(t, "text", "y", features=1 << 10, max_iter=500), lambda m, q: ml.score_tfidf(m, q, "text"))
    want = {r["EIN2"]: r["prob_raw"] for r in one.collect()}
    got = {r["EIN2"]: r["prob_raw"] for r in ml.out_of_fold(x, ml.TextFit("text", "y", features=1 << 10), None).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 5e-3
    # A fold whose training rows have one label, and labels that are none.
    apart = {r["fold"]: r["prob_raw"] for r in ml.out_of_fold(df.withColumn("fold", F.col("y")), ml.TextFit("text", "y", features=1 << 10), None).collect()}
    assert apart == {0: 1.0, 1: 0.0}
    with pytest.raises(ValueError, match="labels"):
        ml.out_of_fold(x.withColumn("y", F.col("y") + 1), ml.TextFit("text", "y"), None)
    monkeypatch.setattr(Q.views, "evaluation", lambda spark, d: df.drop("text"))
    monkeypatch.setattr(Q, "_texts", lambda spark, d: df.select("EIN2", F.col("text").alias("t")))
    monkeypatch.setattr(ml, "fit_tfidf", lambda *a, **k: pytest.fail("a fit of its own for each fold"))
    assert Q.tfidf_scores(spark, "").count() == 59


def test_tfidf_scores_fits_without_a_job_for_each_pass(spark):
    rng = np.random.default_rng(6)
    words = "church prays daily city feeds children with food and hope for all people".split()
    data = [(f"{i:03d}", i % 3 // 2, " ".join(rng.choice(words[i % 3 :], 6))) for i in range(200)]
    x = sampling.folds(spark.createDataFrame(data, "EIN2 string, y int, text string"), "y", "EIN2", 2).localCheckpoint()
    spark.sparkContext.setJobGroup("fits", "")
    try:
        ml.out_of_fold(x, ml.TextFit("text", "y", features=1 << 10), None)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits")) <= 12


def test_folds_settle_in_few_passes_over_rows_that_share_terms(tmp_path):
    from tallyweave.operators import folded

    rng = np.random.default_rng(7)
    rows, at, x = np.zeros(1500, folded.FILES["rows"]), [], np.zeros((1500, 100))
    for i in range(len(rows)):
        y = int(rng.random() < 0.2)
        # One row without terms, one without words; the first places are in almost all rows.
        words, chars = (np.unique(np.append(rng.integers(0, 4, 6), rng.integers(4 + 10 * y, 40, 3))), np.unique(50 + np.append(rng.integers(0, 5, 8), rng.integers(5, 50, 3)))) if i > 1 else (np.zeros(0, int), np.arange(50, 50 + 3 * i))
        rows[i] = (i % 2, y, len(words), 4 if i == 4 else 1, len(words) + len(chars))
        at += [words, chars]
        for k in (words, chars):
            x[i, k] = 1
        x[4, words[:1] if i == 4 else []] = 300
    np.concatenate(at).astype(np.int32).tofile(tmp_path / "a.at")
    places = np.split(np.concatenate(at).astype(int), np.cumsum(rows["terms"])[:-1])
    (tmp_path / "a.n").write_bytes(b"".join(x[i, k].astype(np.float32 if r["size"] == 4 else np.uint8).tobytes() for i, (k, r) in enumerate(zip(places, rows, strict=True))))
    rows.tofile(tmp_path / "a.rows")
    rarity, weights = rng.uniform(1, 3, 100).astype(np.float32), np.array([0.6, 2.5])
    fit = folded._Fit(folded._Rows(f"file://{tmp_path}", ["a"], 1, ""), rarity, weights, 1.0, 1)
    length, passes = fit.settle(2000)
    x, y = (x * rarity)[::2], rows["y"][::2]
    for k in (slice(50), slice(50, 100)):
        x[:, k] /= np.maximum(np.linalg.norm(x[:, k], axis=1, keepdims=True), 1e-9)
    w = fit.terms / rarity
    rate = weights[y] * (1 / (1 + np.exp(-(x @ w + fit.intercept))) - y)
    slope = np.append(x.T @ rate + w, rate.sum())
    assert np.linalg.norm(slope) == pytest.approx(length, rel=1e-6) and length <= folded.SETTLED and passes <= 60


def test_select_arm_has_a_place_for_every_arm(spark, monkeypatch):
    from tallyweave.plans import queries as Q

    cells = spark.createDataFrame([("a", 0.5), ("a", 0.51), ("b", 0.9), ("b", 0.91)], "arm string, score double")
    assert ml.select_arm(cells, "arm", "score", ["a", "b"]).first()["arm"] == "b"
    with pytest.raises(ValueError, match="b"):
        ml.select_arm(cells, "arm", "score", ["a"])
    for best in ("cedar-27b", "elder-flash"):
        data = [(m, f"{m}__v{k}", 0.9 if m == best else 0.5) for m in ("lexicon-rule", "dogwood-nano", "birch-mini", "elder-flash", "cedar-27b", "aspen-large") for k in (1, 2)]
        monkeypatch.setattr(Q.views, "votes", lambda spark, d, data=data: spark.createDataFrame(data, "model_id string, source_id string, confidence double"))
        assert Q.arm_selection(spark, "").first()["arm"] == f"arm_{best}"


def test_dawid_skene_recovers_reliability(spark):
    rng = np.random.default_rng(1)
    data = []
    truth = {}
    for i in range(200):
        z = truth[str(i)] = int(rng.random() < 0.4)
        for s, (tpr, fpr) in enumerate([(0.9, 0.1), (0.85, 0.1), (0.5, 0.5), (0.2, 0.8)]):
            data.append((str(i), str(s), int(rng.random() < (tpr if z else fpr)), 0.9))
    got = V.dawid_skene(votes(spark, data), "EIN2", "source_id", "label").collect()
    assert sum(r["label"] == truth[r["EIN2"]] for r in got) > 175
    with pytest.raises(ValueError):
        V.dawid_skene(votes(spark, [("a", "1", 1, 0.5)]), "EIN2", "source_id", "label")
    with pytest.raises(NotImplementedError):
        V.aggregate_labels(votes(spark, data), "crowdlab", "EIN2", "source_id", "label", "confidence")


def test_null_and_empty_text_are_two_keys(spark):
    raw = spark.createDataFrame([("1", None), ("2", ""), ("3", None)], "id string, t string")
    pred = spark.createDataFrame([(None, 1), ("", 0)], "t string, label int")
    assert rows(relations.expand_back(raw, pred, "t", "id", ["label"]), "id", "label") == [("1", 1), ("2", 0), ("3", 1)]
    with pytest.raises(Exception, match="several predictions"):
        relations.expand_back(raw, pred.union(pred), "t", "id", ["label"]).collect()
    with pytest.raises(Exception, match="no prediction"):
        relations.expand_back(raw, pred.limit(1), "t", "id", ["label"]).collect()
    assert rows(relations.text_multiplicity(raw, "t"), "n_rows") == [(1,), (2,)]
    assert rows(relations.dedup_first(raw, "t", "id"), "id") == [("1",), ("2",)]


def test_completeness_counts_nulls(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    r = relations.completeness(a, b, "k").first()
    assert (r["n_left"], r["n_right"], r["n_missing"], r["n_extra"], r["n_repeated"]) == (4, 2, 2, 1, 1)


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(y * 0.3 + rng.random(300) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(auc)
    for r in metrics.pr_curve(df, "y", "p").collect():
        hit = p >= r["threshold"]
        assert r["tp"] == (hit & (y == 1)).sum() and r["precision"] == pytest.approx((hit & (y == 1)).sum() / hit.sum())
    best = metrics.pick_threshold(df, "y", "p", "precision_floor", 0.9).first()
    ok = [r for r in metrics.pr_curve(df, "y", "p").collect() if r["precision"] >= 0.9]
    assert best["recall"] == max(r["recall"] for r in ok) and best["floor_met"]
    assert not metrics.pick_threshold(df, "y", "p", "precision_floor", 1.01).first()["floor_met"]
    rel = metrics.reliability(df, "y", "p").collect()
    assert len(rel) == 10 and sum(r["n"] for r in rel) == 300
    e = metrics.calibration_errors(df, "y", "p").first()
    assert e["brier"] == pytest.approx(np.mean((p - y) ** 2))
    assert metrics.roc_auc(df.limit(0), "y", "p").first()["roc_auc"] is None
    assert metrics.pearson(df.withColumn("c", F.lit(1.0)), "p", "c").first()["pearson"] is None


def test_subgroups_suppress(spark):
    df = spark.createDataFrame([(1, 1, "a", "x y"), (0, 1, "a", None), (1, 0, None, "x")], "y int, pred int, g string, t string")
    got = {(r["column"], r["value"]): r for r in metrics.subgroups(df, "y", "pred", ["g"], "t", min_n=2).collect()}
    assert got["g", "<missing>"]["suppressed"] and got["g", "<missing>"]["f1"] is None and got["g", "a"]["f1"] == pytest.approx(2 / 3)


def test_allocation():
    given = sampling.largest_remainder({"a": 1.0, "b": 1.0, "c": 2.0}, {"a": 1, "b": 1, "c": 1}, {"a": 2, "b": 50, "c": 50}, 41)
    assert sum(given.values()) == 41 and given["a"] == 2
    with pytest.raises(ValueError):
        sampling.largest_remainder({"a": 1.0}, {"a": 0}, {"a": 2}, 3)
    assert sampling.proportional({"a": 100, "b": 300}, 40) == {"a": 10, "b": 30}
    got = sampling.proportional({"a": 100, "b": 900, "x": 10}, 100, floors={"x"}, floor_size=50)
    assert got["x"] == 10 and sum(got.values()) == 100
    draw = sampling.quota_draw({("s", frozenset({"q"})): 3, ("s", frozenset()): 10, ("t", frozenset({"q"})): 1}, {"s": 5, "t": 1}, {"q": 3})
    assert sum(v for (s, _), v in draw.items() if s == "s") == 5 and sum(v for (_, c), v in draw.items() if "q" in c) >= 3
    with pytest.raises(ValueError):
        sampling.quota_draw({("s", frozenset()): 1}, {"s": 2}, {})


def test_samples(spark):
    df = spark.range(2000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("g"))
    a = sampling.take(df, ["g"], "sample_id", 20, 5)
    assert rows(a, "sample_id") == rows(sampling.take(df.repartition(13), ["g"], "sample_id", 20, 5), "sample_id")
    assert rows(a.groupBy("g").count(), "count") == [(20,)] * 4
    big, small = sampling.nested_subset(df, "g", "sample_id", 0.5), sampling.nested_subset(df, "g", "sample_id", 0.2)
    assert small.join(big, "sample_id", "left_anti").count() == 0
    f = sampling.folds(df, "g", "sample_id", 5).groupBy("g", "fold").count().agg(F.max("count") - F.min("count")).first()[0]
    assert f <= 400
    d = sampling.dev_split(df, "g", "sample_id", 0.1).groupBy("g").agg(F.count_if("is_dev").alias("n"), F.count("*").alias("all")).collect()
    assert all(r["n"] == round(r["all"] * 0.1) for r in d)
    w = sampling.design_weights(df.withColumn("pr", F.lit(0.5)), "pr").agg(F.avg("weight")).first()[0]
    assert w == pytest.approx(1)
    with pytest.raises(ValueError):
        sampling.design_weights(df.withColumn("pr", F.lit(0.0)), "pr")
    lo, hi = sampling.bootstrap_ci((40, 10, 5, 45), lambda tp, fp, fn, tn: 2 * tp / (2 * tp + fp + fn))
    assert lo < 80 / 95 < hi and sampling.bootstrap_ci((40, 10, 5, 45), max) == sampling.bootstrap_ci((40, 10, 5, 45), max)


def test_ppi_covers_truth(spark):
    rng = np.random.default_rng(5)
    p = rng.random(4000)
    y = (rng.random(4000) < 0.2 + 0.5 * p).astype(int)
    df = spark.createDataFrame([(int(a), float(b), i < 300) for i, (a, b) in enumerate(zip(y, p, strict=True))], "y int, p double, lab boolean")
    r = prevalence.ppi(df.filter("lab"), df, "y", "p").first()
    assert r["ci_lower"] <= y.mean() <= r["ci_upper"] and 0 <= r["tuning"] <= 1
    assert prevalence.ppi(df.filter("lab"), df.withColumn("p", F.lit(0.5)), "y", "p").first()["estimate"] is not None
    by = prevalence.prevalence_by_group(df.filter("lab").withColumn("g", F.lit("a")), df.withColumn("g", F.when(F.col("lab"), "a").otherwise("b")), "y", "p", "g")
    assert {r["grp"] if "grp" in r else r["g"]: r["suppressed"] for r in by.collect()} == {"a": False, "b": True}


def test_composite_and_emq(spark):
    parts = spark.createDataFrame([(0.40, 0.010, 75.0), (0.20, 0.020, 25.0)], "estimate double, variance double, n double")
    assert prevalence.composite(parts).first()["estimate"] == pytest.approx(0.35)
    rng = np.random.default_rng(7)
    z = rng.random(20000) < 0.6
    x = np.where(z, rng.normal(1, 1, 20000), rng.normal(-1, 1, 20000))
    post = 0.3 * np.exp(-((x - 1) ** 2) / 2) / (0.3 * np.exp(-((x - 1) ** 2) / 2) + 0.7 * np.exp(-((x + 1) ** 2) / 2))
    df = spark.createDataFrame([(float(v),) for v in post], "p double")
    assert prevalence.emq(df, "p", 0.3)[0] == pytest.approx(0.6, abs=0.02)
    assert prevalence.emq(df.limit(0), "p", 0.3) == (0.3, 0)
    assert prevalence.sensitivity_band(0.3, (0.7, 0.9), (0.8, 0.95)) is not None and prevalence.sensitivity_band(0.3, (0.2, 0.3), (0.2, 0.3)) is None


def test_calibration(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 2, 6000)
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.5 * x + 0.8)))
    df = spark.createDataFrame([(i, int(b), float(1 / (1 + math.exp(-a)))) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, y int, p double")
    f = calibrate.fit_platt(calibrate.score_table(df, "y", "p"))
    assert f.params["a"] == pytest.approx(0.5, abs=0.06) and f.params["b"] == pytest.approx(0.8, abs=0.08)
    out, winner, _, loss = calibrate.crossfit(sampling.folds(df, "y", "id"), "y", "p")
    assert winner == "platt" and loss["platt"] < loss["temperature"] and out.filter("prob_calibrated_oof is null").count() == 0
    t = calibrate.fit_temperature(calibrate.score_table(df.withColumn("y", (F.rand(3) < 1 / (1 + F.exp(-F.log(F.col("p") / (1 - F.col("p"))) / 2))).cast("int")), "y", "p"))
    assert t.params["T"] == pytest.approx(2, abs=0.25)


def test_keyness_counts(spark):
    df = spark.createDataFrame([("cat cat dog", 1.0), ("dog bird", 0.0), (None, 1.0), ("", 0.0), ("a", 1.0)], "t string, w double")
    got = {r["term"]: tuple(r)[1:] for r in keyness.term_counts(df, "t", F.col("w")).collect()}
    assert got == {"cat": (2.0, 0.0, 1), "dog": (1.0, 1.0, 2), "bird": (0.0, 1.0, 1)}
    k = keyness.keyness(keyness.term_counts(df, "t", F.col("w")))
    assert k.orderBy(F.desc("z_score")).first()["term"] == "cat"
    assert [r["term"] for r in keyness.top_absolute(k, 1).collect()] == ["cat"] or keyness.top_absolute(k, 1).count() == 1


def test_names(spark):
    df = spark.createDataFrame([("a", "Short", 2020), ("a", "Longer name", 2019), ("a", None, 2021), ("b", None, None)], "id string, n string, y int")
    assert rows(names.longest_name(df, "id", "n", "y"), "id", "n") == [("a", "Longer name"), ("b", None)]
    x = spark.createDataFrame([("1", "x", 0.9, 1), ("2", "x", 0.9, 0), ("3", "x", 0.1, 0), ("4", "y", 0.5, 1)], "id string, g string, p double, b int")
    assert rows(names.top_k_matched(x, "p", "id", "g", "b"), "id", "predicted") == [("1", 1), ("2", 0), ("3", 0), ("4", 1)]
    d = names.token_difference(spark.createDataFrame([("Hope Church", "Hope Temple"), ("A", "B")], "a string, b string"), "a", "b")
    assert rows(d, "direction") == [("both_names_add_token",)]


def test_answers(spark):
    good = '{"binary_label": "religious", "confidence": 0.9, "domains_present": [], "evidence_spans": ["x"], "boundary_notes": null, "reason": "r"}'
    df = spark.createDataFrame([(good,), ("```json\n" + good + "\n```",), ("{oops",), ('{"binary_label": "religious"}',), (good.replace("religious", "maybe"),), (None,), ("[1]",)], "raw string")
    got = [(r["label"], r["parse_error"]) for r in V.parse_answers(df, "raw").collect()]
    assert got[:3] == [(1, None), (1, None), (None, "malformed JSON")] and got[3][1].startswith("missing keys: boundary_notes") and got[4] == (None, "invalid label: maybe") and got[5][1] == got[6][1] == "malformed JSON"


def test_evidence(spark):
    store = spark.createDataFrame([("a", "s", 1, '["real span", "made up"]'), ("b", "s", 1, None), ("c", "s", 0, "[]"), ("d", "s", 1, '["x"]'), ("e", "s", 1, "not json")], "EIN2 string, source_id string, label int, evidence_spans string")
    texts = spark.createDataFrame([("a", "a real span here"), ("a", "other")], "EIN2 string, t string")
    v = V.verify_evidence(V.evidence_spans(store, "EIN2", "source_id", "evidence_spans"), texts, "EIN2", "t")
    assert rows(v, "EIN2", "span", "verbatim") == [("a", "made up", False), ("a", "real span", True), ("d", "x", None)]
    out = V.abstain_fabricated(store, v.filter("not verbatim"), "EIN2", "source_id", "label")
    assert rows(out, "EIN2", "label") == [("a", None), ("b", 1), ("c", 0), ("d", 1), ("e", 1)]


def test_learning(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 2, [float(rng.normal(i % 2 * 2 - 1, 1)) for _ in range(4)]) for i in range(200)], "id long, y int, v array<double>")
    out = ml.out_of_fold(sampling.folds(df, "y", "id", 2), lambda t: ml.fit_embedding(t, "v", "y"), lambda m, q: ml.score_embedding(m, q, "v"))
    assert metrics.roc_auc(out, "y", "prob_raw").first()["roc_auc"] > 0.9 and out.count() == 200
    t = spark.createDataFrame([(i, i % 2, "the church prays daily" if i % 2 else "the city feeds children") for i in range(40)], "id long, y int, t string")
    m = ml.fit_tfidf(t, "t", "y", features=1 << 10, max_iter=10)
    assert ml.score_tfidf(m, t, "t").filter("(prob_raw > 0.5) != (y = 1)").count() == 0
    s = ml.soft_targets(spark.createDataFrame([(0.25,), (1.0,)], "p double"), "p").groupBy("label").agg(F.sum("weight").alias("w"))
    assert rows(s, "label", "w") == [(0.0, 0.75), (1.0, 1.25)]


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([("12-3456789", "m__p", 1.0)], "EIN2 string, source_id string, label double")
    io.append_store(old, path)
    io.append_store(old.withColumn("EIN2", F.lit("3897281.0")), path)
    assert rows(io.read_store(spark, path), "EIN2", "source_id") == [("EIN-00-3897281", "m__p"), ("EIN-12-3456789", "m__p")]
    with pytest.raises(ValueError):
        io.append_store(old.drop("source_id"), path)
    io.append_store(old.union(old), path)  # a repeated delivery adds nothing
    assert io.read_store(spark, path).count() == 2
    io.replace_store(io.read_store(spark, path).filter("EIN2 = 'EIN-12-3456789'").withColumn("label", F.lit(0.0)), path)
    assert rows(io.read_store(spark, path), "EIN2", "label") == [("EIN-12-3456789", 0.0)] and [p.name for p in tmp_path.iterdir()] == ["store"]
    shards = str(tmp_path / "shards")
    io.write_shards(spark.createDataFrame([(1, 0), (2, 1)], "v int, shard_id int"), shards)
    io.write_shards(spark.createDataFrame([(3, 1)], "v int, shard_id int"), shards)
    assert rows(spark.read.parquet(shards), "v") == [(1,), (3,)]


def test_shards_resume(spark, tmp_path):
    path = str(tmp_path / "run")
    df = spark.createDataFrame([(str(i), f"text {i}") for i in range(60)], "id string, t string")
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        def f(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(p=b["t"].str.len() / 10)

        return x.mapInPandas(f, x.withColumn("p", F.lit(0.0)).schema)

    def run(rows_, settings="v1", **kw):
        before = seen.value
        got = io.score_shards(rows_, path, "id", score, settings, 8, **kw)
        return got.count(), seen.value - before

    assert run(df) == (60, 60)
    assert run(df) == (60, 0)  # nothing left to do
    assert run(df.withColumn("t", F.when(F.col("id") == "7", "changed").otherwise(F.col("t"))))[1] == df.filter("pmod(xxhash64(id), 8) = (select pmod(xxhash64('7'), 8))").count()  # only its shard
    assert run(df, "v2") == (60, 60)  # other settings, all anew
    some = df.filter("pmod(xxhash64(id), 8) < 3")
    assert run(some, "v2", delete_stale=False) == (some.count(), 0) and run(df, "v2") == (60, 0)  # a part leaves the rest alone
    assert run(some, "v2") == (some.count(), 0) and run(df, "v2") == (60, 60 - some.count())  # a full run deletes stale shards
    (tmp_path / "run" / "state").rename(tmp_path / "lost")
    assert run(df, "v2") == (60, 60)  # shards without a state are scored again


def test_running_totals_are_exact(spark):
    rng = np.random.default_rng(5)
    p, y = rng.random(3000).round(4), rng.integers(0, 2, 3000)
    p[:900] = 0.5  # a hot score
    df = spark.createDataFrame([(float(a), int(b), "ab"[i % 2] if i % 7 else None) for i, (a, b) in enumerate(zip(p, y))], "p double, y int, g string")
    order = np.unique(p)[::-1]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.pr_curve(df, "y", "p").collect()}
    assert got == {t: (int(y[p >= t].sum()), int((1 - y)[p >= t].sum()), int(y[p < t].sum())) for t in order}
    per = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "p", ["g"]).collect()}
    for g in ("a", "b", None):
        rows_ = [(a, b) for i, (a, b) in enumerate(zip(p, y)) if ("ab"[i % 2] if i % 7 else None) == g]
        pos, neg = np.array([a for a, b in rows_ if b]), np.array([a for a, b in rows_ if not b])
        assert per[g] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg))


def test_template_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    t = spark.createDataFrame([("a", "validation", 'say "hi",\nthere')], "EIN2 string, split string, text string")
    io.coding_template(t, path)
    io.coding_template(t, path)
    coded = io.read_csv(spark, path, io.TEMPLATE).withColumn("human_label", F.lit("1"))
    assert coded.first()["text"] == 'say "hi",\nthere'
    io.write_csv(spark.createDataFrame(coded.collect(), coded.schema), path)
    with pytest.raises(FileExistsError):
        io.coding_template(t, path)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.csv.gz").write_bytes(b"no archive")
    with pytest.raises(Exception, match="(?i)gz"):
        io.coding_template(t, str(broken))
    assert [f.name for f in broken.iterdir()] == ["part-0.csv.gz"]
    assert rows(io.human_labels(io.read_csv(spark, path, io.TEMPLATE), "validation"), "label") == [(1,)]
    with pytest.raises(PermissionError):
        io.human_labels(coded, "test")


def test_synthetic_and_corpus(spark):
    s = io.synthetic_corpus(spark, 1000)
    assert rows(s, "EIN2", "mission_text") == rows(io.synthetic_corpus(spark, 1000).repartition(7), "EIN2", "mission_text")
    assert 100 < s.filter("label = 1").count() < 200
    m = spark.createDataFrame([(1, "EIN-00-0000001", "same"), (2, "2", "same"), (3, "3", "other")], "rec_id long, EIN2 string, t string")
    reg = spark.createDataFrame([("EIN-00-0000001", "P20"), ("3", "x20")], "EIN2 string, NTEE_IRS string")
    assert rows(io.corpus(m, reg, "EIN2", "t", "NTEE_IRS", "rec_id"), "rec_id", "ntee_major_group") == [(1, "P"), (3, "X")]
    assert io.corpus(m, reg, "EIN2", "t", "NTEE_IRS", "rec_id", deduplicate=False).count() == 3


def test_calibrator_and_batch_files(spark, tmp_path):
    assert io.read_calibrator('{"method": "platt", "params": {"a": 1, "b": 0}, "threshold": 0.5}')["method"] == "platt"
    with pytest.raises(ValueError):
        io.read_calibrator('{"method": "platt", "params": {"a": 1}, "threshold": 0.5}')
    f = tmp_path / "out.jsonl"
    f.write_text('{"custom_id": "1", "response": {"body": {"choices": [{"message": {"content": "x"}}]}}}\n{"custom_id": "2", "error": {"message": "timeout"}}\nbroken\n')
    assert rows(io.batch_results(spark, [str(f)]), "custom_id", "content", "error") == [("1", "x", None), ("2", None, "timeout")]


def test_stream(spark, tmp_path):
    from tallyweave.streaming import store

    src = str(tmp_path / "in")
    one = spark.createDataFrame([("a", "s", 1.0)], "EIN2 string, source_id string, label double").withColumn("run_timestamp", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    io.append_store(one, src)
    again = io.read_store(spark, src)
    spark.createDataFrame(again.collect(), again.schema).write.mode("append").parquet(src)  # delivered twice
    store.start(store.votes(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    store.audit(store.votes(spark, src), one.withColumn("label", F.col("label").cast("int")), str(tmp_path / "audit"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "audit")).agg(F.sum("n_common")).first()[0] == 1


def test_annotators_plug_in(spark):
    from tallyweave.operators.annotate import Annotator, annotate

    def connect():
        def answer(texts):
            if "boom" in texts:
                raise TimeoutError("late")
            return ['{"binary_label": "%s", "confidence": 1, "domains_present": [], "evidence_spans": [], "boundary_notes": null, "reason": ""}' % ("religious" if "church" in t else "nonreligious") for t in texts]

        return answer

    a = Annotator("m", "p", connect, retries=2, first_wait=0.01)
    got = rows(annotate(spark.createDataFrame([("1", "a church"), ("2", None)], "id string, t string").coalesce(1), a, "id", "t"), "id", "source_id", "label", "error")
    assert got == [("1", "m__p", 1, None), ("2", "m__p", 0, None)]
    got = annotate(spark.createDataFrame([("1", "boom")], "id string, t string"), a, "id", "t").first()
    assert got["label"] is None and got["error"] == "TimeoutError: late"


def test_slate_falls_back(spark):
    df = spark.createDataFrame([("a", 0.9, 0.8, 0.75), ("b", 0.95, None, 0.5)], "n string, f1 double, k double, low double")
    assert rows(ml.slate(df, "n", "f1", "k", "low"), "n", "place", "selected") == [("a", 2, True), ("b", 1, False)]
    assert rows(ml.slate(df, "n", "f1", "k", "low", 0.99), "n", "selected") == [("a", False), ("b", True)]
