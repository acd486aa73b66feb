import random

import numpy as np
import pytest

from tallyweave.llm import sentences, truncation

WHO = ["young parents", "cancer patients", "military veterans", "small farmers", "local artists", "refugee women"]
WHAT = ["literacy tutoring", "hot meals", "home weatherization", "science fairs", "vaccination clinics", "trail restoration"]
WHERE = ["Bregreh", "Crotou", "Maivoss", "Drukli", "Zaisefist", "Kaehabl", "Proustae", "Flibrond", "Stadreark", "Wuthel"]


def text(rng):
    out = []
    for _ in range(rng.randint(2, 5)):
        out.append(f"{rng.choice(['We provide', 'Our volunteers support', 'The center arranges'])} {rng.choice(WHAT)} and {rng.choice(WHAT)} for {rng.choice(WHO)} in {rng.choice(WHERE)}{rng.choice(['', ' Valley', ' County'])}.")
    return " ".join(out)


FRAME = "rec_id long, EIN2 string, t string, y int, s string"


def test_truncation_on_planted_cuts(spark):
    rng = random.Random(1)
    rows, cut = [], set()
    for i in range(3000):
        t, s, y = text(rng), rng.choice(["short", "full"]), rng.choice([2010, 2011, None])
        if s == "short" and len(t) > 200:
            t = t[:200].rstrip()
        elif rng.random() < 0.04:
            t = t[: rng.randint(60, max(61, len(t) - 2))].rstrip()
        elif rng.random() < 0.1:
            t = t[:-1]  # only the closing mark is missing
        if t[-1] != "." and (s == "short" and len(t) >= 199 or not any(t.endswith(w) for w in (*WHERE, "Valley", "County"))):
            cut.add(i)
        rows.append((i, f"{i:09d}", t, y, s))
    n = len(rows)
    extra = [None, "", "  ", "N/A", "N/A", "N/A", "N/A", "N/A", "We provide hot mea�", "x" * 50_000]
    rows += [(n + k, f"9{k:08d}", t, None, None if k % 2 else "full") for k, t in enumerate(extra)]
    df = spark.createDataFrame(rows, FRAME)
    judged = truncation.truncation(df, "rec_id", "t", "s", "y", "EIN2").cache()
    got = {r["id"]: r for r in judged.collect()}
    found = {i for i, r in got.items() if r["cut"] and i < n}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95
    assert n not in got and n + 1 not in got and n + 2 not in got and not got[n + 3]["cut"] and got[n + 8]["cut"]
    whole = [i for i in range(n) if rows[i][2].endswith(".")]
    assert not any(got[i]["cut"] for i in whole)
    rep = {r["source"]: r for r in truncation.report(judged).collect()}
    assert rep["short"]["n_at_limit"] > rep["full"]["n_at_limit"] == 0


def test_truncation_of_nothing(spark):
    assert truncation.truncation(spark.createDataFrame([], FRAME), "rec_id", "t", "s", "y", "EIN2").count() == 0


def test_censored_fit_recovers():
    rng = np.random.default_rng(1)
    x = np.round(np.exp(rng.normal(5, 0.6, 20000))).astype(int)
    lengths, counts = np.unique(np.minimum(x, 255), return_counts=True)
    mu, sd = truncation.censored_fit(lengths, counts, 255)
    assert mu == pytest.approx(5, abs=0.05) and sd == pytest.approx(0.6, abs=0.05)


def limited(spark, limit, longest, n=3000, also=(), year=lambda rng: 2010):
    """Texts cut at a limit: (rows, ids at the limit); ``also`` are lengths of whole texts beyond it."""
    rng = random.Random(4)
    rows, at = [], set()
    while len(rows) < n:
        t = " ".join(text(rng) for _ in range(rng.randint(1, max(1, longest // 150))))
        y = year(rng)
        if len(t) > limit:
            t = t[:limit]
            if t[-1] not in ". " and t[-2] != ".":
                at.add(len(rows))
        rows.append((len(rows), f"{len(rows):09d}", t, y, "s"))
    rows += [(n + k, f"9{k:08d}", ("Whole " * size)[: size - 1].rstrip() + ".", year(rng), "s") for k, size in enumerate(also)]
    return spark.createDataFrame(rows, FRAME), at


@pytest.mark.parametrize("limit,longest,n,also", [(500, 900, 3000, ()), (500, 900, 3000, (640,)), (500, 900, 3000, (501, 502, 640, 2000)), (32_767, 60_000, 300, ()), (32_767, 60_000, 300, (40_000,))])
def test_limits_at_exact_lengths(spark, limit, longest, n, also):
    df, at = limited(spark, limit, longest, n, also)
    got = {r["id"]: r for r in truncation.truncation(df, "rec_id", "t", "s", "y", "EIN2").collect()}
    assert len(at) > 60 and all(got[i]["at_limit"] > 0.95 for i in at) and sum(got[i]["cut"] for i in at) / len(at) > 0.99
    assert all(r["at_limit"] == 0 for r in got.values() if not limit - 1 <= r["length"] <= limit)
    assert not any(r["cut"] for i, r in got.items() if i >= n)


def test_limits_of_years():
    body = [(y, x, 3) for y in (2010, 2011, 2012, None) for x in range(60, 300)]
    found = truncation.find_limits(body + [(2010, 300, 90), (2011, 300, 5), (None, 300, 4)] + [(2012, x, 3) for x in range(300, 500)])
    assert found[2010, 300] > 0.9 and found[2010, 299] == found[2010, 300] and found[2011, 300] > 0.9  # few texts at it, but none longer
    assert (2012, 300) not in found or found[2012, 300] < 0.01
    assert found[None, 300] > 0.8 and set(found) <= {(y, x) for y in (2010, 2011, 2012, None) for x in (299, 300)}
    assert truncation.find_limits(body) == {} and truncation.find_limits([(None, 7, 1)]) == {}
    assert truncation.find_limits([(None, x, 3) for x in range(60, 300)] + [(None, 300, 90)])[None, 300] > 0.9  # no dates at all


def test_continued_text_is_cut(spark):
    t = "We provide hot meals and warm beds for many of the people who live in Maivoss"
    rows = [(1, "1", t, 2010, "a"), (2, "1", t + " Valley and beyond it.", 2011, "b"), (3, "2", t, 2010, "a"), (4, "3", t.upper() + "...", 2010, "a"), (5, "3", t + " and more", 2010, "a"), (6, "4", t, 2010, "a"), (7, "4", t + ".", 2010, "a"), (8, None, t, 2010, "a"), (9, None, t + " Valley", 2010, "a"), (10, "1", t, 2012, "a")]
    got = {r["id"]: r["evidence"] for r in truncation.truncation(spark.createDataFrame(rows, FRAME), "rec_id", "t", "s", "y", "EIN2").collect()}
    assert {i for i, e in got.items() if e == 10} == {1, 4, 10}


def test_marks():
    assert truncation.split_mark("and more...") == ("and more", "dots") and truncation.split_mark("wor… ") == ("wor", "dots")
    assert truncation.split_mark("refuge &#82") == ("refuge", "broken") and truncation.split_mark("R & D work.") == ("R & D work.", "")
    assert truncation.unclosed("One. (two and") and not truncation.unclosed("One (two).")


BLOCKS = [
    ["Dr. Adams runs the clinic.", "It opened in 1990!", '"No one eats alone!" is the rule.', "Doors open at 6 a.m. and close at 8 p.m. on weekdays.", "We serve many (e.g. young parents) here."],
    ["Mr. and Mrs. Stone gave 3.5 million.", "Who will help?", "We need beds ... and quickly.", "Classes end by 8 p.m.", "Thank you!"],
    ["The U.S. office files Form 990 v2.1 each spring.", "See plan.v2.pdf, item No. 2, for more.", "He wrote: \"It was patience.\"", "(We sing on Sundays.)", "Rev. J. R. Moss came."],
]
OTHER = [
    ["校长说：“我们会继续开放。”", "谢谢大家！", "“人人有饭吃！”是我们的口号。", "全年支出为5.5万元。"],
    ["डॉ. मेता ने केंद्र शुरू किया।", '"कोई भूखा न रहे।" यही हमारा नारा है।', "सभी को धन्यवाद!"],
    ["Wir helfen z. B. Familien in Bonn.", "Am 9. Mai öffnet das Haus.", "Sie sagte: „Wir bleiben offen.“"],
    ["« Personne ne mange seul ! » est notre devise.", "Merci à tous !", "Mme Roy et le Dr. Paul aident."],
    ["В 1962 г. мы открыли приют.", "«Никто не один!» — говорят они.", "Директор И. П. Горин ведёт кружок."],
]


def corpus(seed=3, n=500):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        pool = rng.choice([*BLOCKS, *BLOCKS, *OTHER])
        said = [rng.choice(pool) for _ in range(rng.randint(2, 7))]
        t, spans = "", []
        for k, s in enumerate(said):
            gap = "" if k == 0 else rng.choice(["\n\n", "\r\n\r\n", "\n\n\n"]) if rng.random() < 0.4 else "" if "一" < s[0] < "鿿" else " "
            t += gap
            spans.append((len(t), len(t) + len(s)))
            t += s
        docs.append((t, spans))
    return docs


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t,) for t, _ in corpus()], "t string")
    return sentences.learn(df)


def test_sentences_on_built_texts(model):
    good = found = want = 0
    for t, spans in corpus(9, 300):
        got = set(sentences.split(t, model))
        good, found, want = good + len(got & set(spans)), found + len(got), want + len(spans)
    assert good / found > 0.97 and good / want > 0.97


@pytest.mark.parametrize(
    "text,want",
    [
        ("History\n\nIt opened in 1990! Thank you!", ["History", "It opened in 1990!", "Thank you!"]),
        ("We do:\n\n1. Hot meals for all\n2. Warm beds.\n- More\nThank you!", ["We do:", "1. Hot meals for all", "2. Warm beds.", "- More", "Thank you!"]),
        ("Can\nwe do more? Thank you!", ["Can\nwe do more?", "Thank you!"]),
        ("It opened in 1990.Thank you!", ["It opened in 1990.", "Thank you!"]),
        ("ขอบคุณทุกท่าน มี 25 คนมา\nวันนี้ดี", ["ขอบคุณทุกท่าน", "มี 25 คนมา", "วันนี้ดี"]),
        ("Annual Report of the Riverside Youth Center\nThe center served many families.", ["Annual Report of the Riverside Youth Center", "The center served many families."]),
        ("History\nIt opened in 1990!\nOur Work\nWe need beds ... and quickly.", ["History", "It opened in 1990!", "Our Work", "We need beds ... and quickly."]),
        (f"{'A Very Long Heading of Many Words ' * 20}\nThank you!", [("A Very Long Heading of Many Words " * 20).strip(), "Thank you!"]),
        ("Annual Report\nof the center came out.", ["Annual Report\nof the center came out."]),
        ("", []), (None, []), (" \n　", []), ("no mark at all", ["no mark at all"]), ("...", ["..."]),
    ],
)
def test_rules(model, text, want):
    assert [text[a:b] for a, b in sentences.split(text, model)] == want


def test_headings_without_a_trained_model():
    heading = "Annual Report of the Riverside Youth Center\nThe center served many families."
    assert [heading[a:b] for a, b in sentences.split(heading, sentences.Model({}, frozenset()))] == heading.split("\n")


def test_headings_in_scripts_without_case_are_known_from_elsewhere(spark):
    docs = [("年度报告\n\n谢谢大家！",)] * 6 + [("年度报告\n校长说：“我们会继续开放。”谢谢大家！",)]
    model = sentences.learn(spark.createDataFrame(docs, "t string"))
    assert docs[-1][0][:4] == docs[-1][0][slice(*sentences.split(docs[-1][0], model)[0])]


def test_tokens_reach_beyond_any_window(model):
    long = "x" * 300
    t = f"We met {long}. The{' ' * 90}end came."
    found = list(sentences.sites(t, (0, 0, len(t)), len(t), len(t)))
    assert found[0].context.split("\n")[0] == long and found[0].pair == "the end"


def test_one_letter_starts_after_a_missing_blank():
    # the candidates only; whether one ends a sentence is the classifier's
    ends = lambda t: [s.end for s in sentences.sites(t, (0, 0, len(t)), len(t), len(t)) if not s.last]
    for t in ("It pays tradespeople.A fund named after Stone helps.", "Hay comida caliente.Y todos ayudan.", "Мы открыли приют.В нём живут дети.", "C'est notre devise.L'équipe aide.", "It opened in 1990.I came."):
        assert ends(t) == [t.index(".") + 1], t
    assert ends("The U.S.A team ran plan v2.A fund.") == [] and ends("See item.pdf, plan.B2 and area.A.") == []


def test_a_sentence_that_starts_with_a_after_a_missing_blank(spark):
    said, fund = "It pays tradespeople.", [f"A fund named after {w} helps." for w in WHERE]
    built = [f"{t}\n\n{said}\n\n{fund[k % 10]}" if k % 3 else f"{t} {said} {fund[k % 10]}" for k, (t, _) in enumerate(corpus())]
    model = sentences.learn(spark.createDataFrame([(t,) for t in built], "t string"))
    t = "It pays tradespeople.A fund named after Stone helps."
    assert [t[a:b] for a, b in sentences.split(t, model)] == ["It pays tradespeople.", "A fund named after Stone helps."]


def test_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "Thank you! Who will help?"), (3, "Thank you!"), (4, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start_char")
    got = sorted(map(tuple, sentences.sentences(df, "doc_id", "text", model).collect()))
    assert got == [(3, 0, 10), (3, 0, 10), (3, 11, 25), (4, 0, 199_999)]
    said = sentences.sentences(df, "doc_id", "text", model, with_text=True)
    assert sorted(r["sentence"] for r in said.collect() if r["doc_id"] < 4) == ["Thank you!", "Thank you!", "Who will help?"]
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0
    assert sentences.sentences(df.filter("doc_id < 3"), "doc_id", "text").count() == 0
