import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import lookalike, overlap
from tallyweave.llm.fm_index import FmIndex, within


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_index_finds_all_places():
    rng = random.Random(2)
    for _ in range(80):
        docs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 6))]
        ix = FmIndex.load(FmIndex.build(np.array([w * 7 for d in docs for w in d], np.int64), np.array([len(d) for d in docs])).dump())
        pats = [[rng.randint(1, 5) for _ in range(rng.randint(1, 4))] for _ in range(8)]
        ids = ix.ids(np.array([w * 7 for p in pats for w in p], np.int64))
        ends = np.cumsum([len(p) for p in pats])
        low, high = ix.backward(ids, ends - [len(p) for p in pats], ends)
        for p, a, b in zip(pats, low, high, strict=True):
            want = sorted(int(ix.starts[k]) + i for k, d in enumerate(docs) for i in range(len(d) - len(p) + 1) if d[i : i + len(p)] == p)
            assert sorted(ix.places(np.arange(a, b))) == want


def test_distance():
    rng = random.Random(3)
    a = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(800)]
    b = [[x if rng.random() < 0.8 else rng.randint(1, 3) for x in d if rng.random() < 0.9] for d in a]
    flat = lambda x: (np.array([w for d in x for w in d]), np.cumsum([len(d) for d in x]) - [len(d) for d in x], np.array([len(d) for d in x]))
    most = np.array([rng.randint(0, 4) for _ in a])
    for x, y, g, m in zip(a, b, within(*flat(a), *flat(b), most), most, strict=True):
        d = lev(x, y)
        assert g == (d if d <= m else -1)


def brute(rows):
    ws = {i: overlap.words(lookalike.consistent_form(t)) for i, _, t, _ in rows}
    out = set()
    for i, e, _, s in rows:
        for j, f, _, u in rows:
            if s == "train" and u not in ("train", None):
                n = max(len(ws[i]), len(ws[j]))
                near = min(len(ws[i]), len(ws[j])) >= 8 and lev(ws[i], ws[j]) <= n // 10
                if near or (e and e == f):
                    out.add((min(i, j), max(i, j)))
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(25)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 9, 10, 11, 19, 20, 30, 60, 150]))] for _ in range(60)]
    rows = []
    for k in range(500):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            how = rng.random()
            if how < 0.34:
                w.insert(at, "new")
            elif at < len(w):
                w[at : at + 1] = [] if how < 0.67 else ["other"]
        text = rng.choice([" ", "  ", ", "]).join(w)
        rows.append((k, rng.choice([None, "123456789", f"{k:09d}"]) if k % 20 == 0 else None, text.upper() if k % 3 else text, rng.choice(["train", "train", "test", "validation"])))
    rows += [(900, None, None, "train"), (901, None, "", "test"), (902, None, "   ", "train"), (903, "123456789", None, "train"), (904, None, " ".join(base[0]), None)]
    df = spark.createDataFrame(rows, "sample_id long, EIN2 string, mission_text string, split string")
    got = overlap.overlaps(df, "sample_id", "mission_text", "EIN2", "split").collect()
    pairs = [(r["id_a"], r["id_b"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows)
    assert all(r["matched_words"] > 0 and r["spans"] >= 1 for r in got if r["by_text"])


def test_words_of_ascii_texts_as_of_others():
    rng = random.Random(8)
    for _ in range(2000):
        t = "".join(rng.choice("ab Z9_-.'’\n\t(é中ก") for _ in range(rng.randint(0, 12)))
        want = overlap._WORD.findall(overlap._APOSTROPHES.sub("", t.casefold()))
        assert overlap.words(t) == want, ascii(t)
    assert overlap.words(None) == []


def test_chains_bound_the_distance():
    rng = random.Random(7)
    docs = [[rng.randint(1, 6) for _ in range(rng.randint(1, 30))] for _ in range(400)]
    near = [[x if rng.random() < 0.9 else rng.randint(1, 6) for x in d if rng.random() < 0.95] or [1] for d in docs]
    flat = lambda x: (np.array([w for d in x for w in d]), np.cumsum([len(d) for d in x]) - [len(d) for d in x], np.array([len(d) for d in x]))
    (a, a0, an), (b, b0, bn) = flat(docs), flat(near)
    pair = np.repeat(np.arange(len(docs)), 3)
    x, y = (np.array([rng.randrange(k) for k in n[pair]]) for n in (an, bn))
    same = a[a0[pair] + x] == b[b0[pair] + y]
    pair, x, y = pair[same], x[same], y[same]
    left, right = overlap._maximal(a, a0[pair], an[pair], x, b, b0[pair], bn[pair], y)
    for k, c in enumerate(overlap._chained(pair, left, right, y - x, an, bn)):
        assert lev(docs[k], near[k]) <= c


def test_small_shards_give_the_same(spark, monkeypatch):
    rows = [(i, f"one two three four five six seven eight nine {'ten' if i % 2 else 'zehn'} eleven {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "i long, norm string").selectExpr("unhex(md5(concat(norm, i))) as key", "norm", "i")
    a, b = df.filter("i < 20").select("key", "norm"), df.filter("i >= 20").select("key", "norm")
    one = sorted(map(tuple, overlap.text_overlaps(a, b).collect()))
    assert one and one == sorted(map(tuple, overlap.text_overlaps(a, b, shard_words=40).collect()))


def test_empty_splits(spark):
    df = spark.createDataFrame([(1, None, "a b c d e f g h i j", "train")], "sample_id long, EIN2 string, mission_text string, split string")
    assert overlap.overlaps(df, "sample_id", "mission_text", "EIN2", "split").count() == 0
    assert overlap.overlaps(df.limit(0), "sample_id", "mission_text", "EIN2", "split").count() == 0


def test_report(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, "1", t, "train", "s"), (2, "2", t, "test", "s"), (3, None, t, "test", None)], "sample_id long, EIN2 string, mission_text string, split string, data_source string")
    p = overlap.overlaps(df, "sample_id", "mission_text", "EIN2", "split")
    got = {(r["split"], r["data_source"]): (r["n_rows"], r["n_overlapping"], r["n_pairs"], r["n_spans"], r["matched_words"]) for r in overlap.report(df, p, "sample_id", "split", "data_source").collect()}
    assert got == {("train", "s"): (1, 1, 2, 2, 20), ("test", "s"): (1, 1, 1, 1, 10), ("test", None): (1, 1, 1, 1, 10)}


SAME = [
    ("Latin manage", "Latin mаnage"), ("café", "café"), ("ABC 12", "ＡＢＣ　１２"), ("office fun", "oﬃce fun"), ("zero", "ze​ro﻿"),
    ("Программа", "Прогpaмма"), ("Since", "Ꮪince"), ("program", "proɡram"), ("ёлка", "ёлка"), ("K", "K"), ("civic", "ⅽiviс"),
    ("soft", "so­ft"), ("paɡe", "pɑge"), ("a b", "a\tb"), ("СОСО мир", "COCO мир"),
]
OTHER = [("2", "²"), ("TM", "™"), ("No 5", "№ 5"), ("1/2", "½"), ("a", "á"), ("a b", "a  b"), ("A", "a"), ('"x"', "“x”"), ("a;", "a."), ("a b", "ab")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalike.consistent_form(a) == lookalike.consistent_form(b)
    assert lookalike.consistent_form(lookalike.consistent_form(b)) == lookalike.consistent_form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert lookalike.consistent_form(a) != lookalike.consistent_form(b)


def test_script_of_the_text_decides():
    assert lookalike.consistent_form("Он был c нами") == "Он был с нами"
    assert lookalike.consistent_form("with а friend") == "with a friend"


def test_pairs(spark):
    rows = [(1, "manage"), (2, "mаnage"), (3, "manage"), (4, None), (5, ""), (6, "　"), (7, " "), (8, "other"), (9, "other"), (10, "man‍age")]
    df = spark.createDataFrame(rows, "sample_id long, mission_text string").selectExpr("*", "'x' as form", "1 as f")
    got = sorted(tuple(r) for r in lookalike.pairs(df, "sample_id", "mission_text").collect())
    assert got == [(1, 2), (1, 10), (2, 3), (2, 10), (3, 10)]
    forms = {r["sample_id"]: r["form"] for r in lookalike.with_form(df, "mission_text").collect()}
    assert forms[4] is None and forms[5] == "" and forms[6] == " " and Counter(forms.values())["manage"] == 4
    assert lookalike.pairs(df.limit(0), "sample_id", "mission_text").count() == 0
    assert lookalike.pairs(df.limit(0), "sample_id", "mission_text").count() == 0
    long = "x" * 100_000 + "а"
    assert lookalike.consistent_form(long) == "x" * 100_000 + "a"


def test_pairs_of_a_hot_form(spark):
    # 100,000 copies of one text and one look-alike: as many pairs, and no more work than that
    df = spark.range(100_001).selectExpr("id as sample_id", "if(id = 70000, 'Our mаnager helps.', 'Our manager helps.') as mission_text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = time.time()
        got = lookalike.pairs(df, "sample_id", "mission_text").agg(F.count("*").alias("n"), F.count_if(F.expr("sample_id_a = 70000 or sample_id_b = 70000")).alias("with"), F.count_if(F.expr("sample_id_a < sample_id_b")).alias("ordered")).first()
        assert tuple(got) == (100_000,) * 3 and time.time() - began < 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
