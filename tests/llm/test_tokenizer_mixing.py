import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing, tokenizer

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokenizer.default_path())
    t.encode_special_tokens = True
    return t


def test_random_texts_match_the_library(library):
    a = tokenizer.automaton(tokenizer.default_path())
    rng = random.Random(4)
    parts = ["a", "aa", "e", "he", "the", " the", " ", "  ", "\n", "\x85", "ß", "é", "ก", "🎉", "1", "12", "½", "__", "--", "‍", "　", "'s", "<|endoftext|>", "中文", "0" * 40, "…"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        ids = a.encode(s)
        assert ids == library.encode(s, add_special_tokens=False).ids, ascii(s)
        assert a.decode(ids) == s


def test_edges(spark, library):
    long = "word " * 5000 + "x" * 20000
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, " ", 9), (4, "same", 9), (4, "same", 9), (5, long, 9)], "doc_id long, text string, ids long")
    got = [(r["doc_id"], r["ids"]) for r in tokenizer.encode(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert got[0] == (1, []) and got[1] == (2, []) and got[3] == got[4] and got[5][1] == library.encode(long, add_special_tokens=False).ids
    back = tokenizer.decode(tokenizer.encode(df, "doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ["", "", " ", "same", "same", long]
    n = tokenizer.count_tokens(df, ["doc_id"], "text").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in n][:5] == [0, 0, 1, 1, 1]
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


TARGETS = "mix_id int, source string, target_weight double, max_repeats int, budget_tokens long"


def mix(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    tokens = mixing.token_table(d, "doc_id", "text", "source")
    planned = mixing.plan(tokens, spark.createDataFrame(targets, TARGETS))
    return tokens, planned, mixing.realise(tokens, planned, blocks=8)


def test_mix_meets_budget_and_repeats(spark):
    docs = [(i, " a" * (1 + i % 5), ["Big_One", "big-one ", "BIG ONE"][i % 3]) for i in range(300)] + [(1000 + i, " b b", "small") for i in range(5)] + [(2000, None, "small"), (2001, "", None)]
    tokens, planned, mixed = mix(spark, docs, [(1, "big_one", 0.7, 1, 600), (1, "small", 0.2, 3, 600), (1, "gone", 0.1, 9, 600)])
    got = {r["source"]: r for r in planned.collect()}
    assert got["big_one"]["tokens"] == 900 and got["small"]["tokens"] == 10 and got["gone"]["tokens"] == 0
    assert got["small"]["given"] == 30 and got["big_one"]["given"] == 570
    used = {r["source"]: r for r in mixing.actual(planned, mixed).collect()}
    assert 565 < used["big_one"]["actual_tokens"] <= 570 and used["small"]["actual_tokens"] == 30 and used["small"]["most_repeats"] == 3
    assert [used[s]["falls_short"] for s in ("big_one", "small", "gone")] == [False, True, True]
    assert sum(r["actual_share"] for r in used.values()) == pytest.approx(1)
    assert mixed.groupBy("doc").count().filter("count > 1").count() == 0
    again = mixing.realise(tokens.repartition(9), planned, blocks=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_mix_without_documents_or_targets(spark):
    tokens, planned, mixed = mix(spark, [], [(1, "x", 1.0, 2, 100)])
    assert mixing.actual(planned, mixed).first()["falls_short"] and mixed.count() == 0
    assert mixing.plan(tokens, spark.createDataFrame([], TARGETS)).count() == 0


def test_exponents():
    sizes = [100.0, 10.0, 1.0]
    e = mixing.entropy_exponent(sizes, mixing.tempered(sizes, 0.4))
    assert e == pytest.approx(0.4, abs=1e-6) and mixing.tempered(sizes, 0.0) == pytest.approx([1 / 3] * 3) and mixing.tempered([0.0, 0.0], 1.0) == [0.0, 0.0]
    rows = [{"source": s, "target_weight": w, "max_repeats": 1, "tokens": t} for s, w, t in (("a", 0.6, 10), ("b", 0.2, 30), ("c", 0.2, 1000))]
    out = {r["source"]: r for r in mixing.plan_mix(rows, 100)}
    assert out["a"]["given"] == 10 and sum(r["given"] for r in out.values()) == pytest.approx(100) and all(r["given"] <= r["capacity"] for r in out.values())


def test_open_budget_follows_the_tempered_shares():
    rows = [{"source": s, "target_weight": w, "max_repeats": 2, "tokens": t} for s, w, t in (("a", 0.6, 10), ("b", 0.2, 400), ("c", 0.2, 1600))]
    out = {r["source"]: r for r in mixing.plan_mix(rows, 100)}
    e = out["b"]["entropy_exponent"]
    w = mixing.tempered([400.0, 1600.0], e)
    assert out["b"]["spread_exponent"] == e and out["b"]["given"] == pytest.approx(20 + 40 * w[0]) and out["c"]["given"] == pytest.approx(20 + 40 * w[1])
    tight = [{"source": s, "target_weight": w, "max_repeats": 1, "tokens": t} for s, w, t in (("a", 0.8, 10), ("b", 0.1, 25), ("c", 0.1, 1600))]
    out = {r["source"]: r for r in mixing.plan_mix(tight, 100)}
    assert out["b"]["given"] <= 25 + 1e-9 and out["b"]["spread_exponent"] >= out["b"]["entropy_exponent"] and sum(r["given"] for r in out.values()) == pytest.approx(100)
    assert all(r["spread_exponent"] is None and r["given"] == r["asked"] for r in mixing.plan_mix(rows[1:], 100))


def test_source_names(spark):
    got = spark.createDataFrame([(" Efile-Narrative ",), ("EFILE NARRATIVE",), ("",), (None,)], "s string").select(mixing.source_name(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == ["efile_narrative", "efile_narrative", None, None]
