import pytest
from pyspark.sql import functions as F

from tallyweave.functions import scores as S
from tallyweave.functions import text as T
from tallyweave.functions.ids import nine_digits, standard_ein


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [("EIN-12-3456789", "123456789"), (" ein 12 3456789 ", "123456789"), ("3897281.0", "003897281"), ("12-3456789", "123456789"), ("", None), (None, None), ("1234567890", None), ("n/a", None)],
)
def test_ids(spark, raw, want):
    assert one(spark, raw, nine_digits("t")) == want
    assert one(spark, raw, standard_ein("t")) == (want and f"EIN-{want[:2]}-{want[2:]}")


@pytest.mark.parametrize(
    "text,q",
    [
        ("Provide housing for children, families and veterans. We support art, music.", 6.0 - 0.5),
        ("", -1.0), (None, -1.0), ("general charitable purposes", -2.0 - 1.0), ("for general charitable purposes", 0.5 - 2.0), ("church", -1.0), ("support seniors with meals in the city", 0.5 + 4),
    ],
)
def test_quality(spark, text, q):
    assert one(spark, text, T.quality("t")["q"]) == pytest.approx(q)


def test_word_boundaries_are_unicode(spark):
    assert one(spark, "égliséchurch", T.has_any("t", ["church"])) is False
    assert one(spark, "a CHURCH.", T.has_any("t", ["church"])) is True
    assert one(spark, "low-income people", T.has_any("t", ["low-income"])) is True


@pytest.mark.parametrize("text,label", [("The Baptist home", 1), ("short text", 0), ("a faith of some kind", None), ("one two three four five six seven", None), (None, 0)])
def test_rule(spark, text, label):
    assert one(spark, text, T.rule_label("t")) == label


def test_route(spark):
    rows = [("baptist", "low "), ("short", "LOW"), ("a faith thing", "LOW"), ("baptist", "HIGH"), (None, None)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, tier string").select(T.route("t", "tier")["source"].alias("s")).collect()]
    assert got == ["rule_strong_positive", "rule_short_negative", "low_via_classifier", "classifier", "classifier"]
    got = spark.createDataFrame([("a faith thing", "LOW")], "t string, tier string").select(T.route("t", "tier", ambiguous_to_classifier=False).alias("r")).first()["r"]
    assert (got["source"], got["label"]) == ("rule_abstain", None)


@pytest.mark.parametrize(
    "text,want",
    [("St. Mary hospital", "saint"), ("Saint Mary church", "none"), ("spiritual growth", "spiritual"), ("a ministry of care", "ministry"), ("faith in people", "faith_heritage"), ("for religious, charitable and educational aims", "boilerplate_religious"), (None, "none")],
)
def test_boundary(spark, text, want):
    assert one(spark, text, T.boundary_class("t")) == want


def test_small_functions(spark):
    assert one(spark, " x20", T.group_letter("t")) == "X" and one(spark, "9", T.group_letter("t")) == "?" and one(spark, None, T.group_letter("t")) == "?"
    assert one(spark, "ACME CORP, INC.", T.clean_name("t")) == "Acme" and one(spark, "ame zion church", T.clean_name("t")) == "AME Zion Church"
    assert one(spark, "a__b__v1", T.source_parts("t")["model_id"]) == "a__b" and one(spark, "a__b__v1", T.source_parts("t")["prompt_id"]) == "v1"
    assert one(spark, '```json\n{"a": 1}\n```', T.strip_fence("t")) == '{"a": 1}'
    assert one(spark, "The cat, the dog", T.ngrams(T.tokens("t", ["the"]), 1, 2)) == ["cat", "dog", "cat dog"]
    assert one(spark, "x", T.ngrams(T.tokens("t"), 1, 2)) == []
    assert one(spark, "x" * 996, T.truncation_flag("t")) is True and one(spark, None, T.truncation_flag("t")) is False


def test_known_rates(spark):
    w = spark.range(1).select(S.wilson(F.lit(11), F.lit(13)).alias("a"), S.wilson(F.lit(54), F.lit(54)).alias("b")).first()
    assert w["a"]["low"] == pytest.approx(0.5776536898) and w["a"]["high"] == pytest.approx(0.9567418216) and w["b"]["low"] == pytest.approx(0.9335864119) and w["b"]["high"] == 1
    m = S.confusion_metrics(F.lit(76), F.lit(17), F.lit(1), F.lit(81))
    got = spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()
    assert [round(got[k], 4) for k in ("precision", "recall", "f1", "mcc")] == [0.8172, 0.9870, 0.8941, 0.8093]
    none = spark.range(1).select(*[v.alias(k) for k, v in S.confusion_metrics(*[F.lit(0)] * 4).items()]).first()
    assert none["f1"] == 0 and none["alpha"] is None
    assert spark.range(1).select(S.rogan_gladen(F.lit(0.32), F.lit(0.8), F.lit(0.9)).alias("x")).first()["x"] == pytest.approx(0.22 / 0.7)
    assert spark.range(1).select(S.rogan_gladen(F.lit(0.32), F.lit(0.4), F.lit(0.5)).alias("x")).first()["x"] is None
