"""One consistent form for texts that look the same.

A token is a run of letters and marks. Each of its characters can be spelled in a set of scripts: its
own, and those with a letter of the same look. The intersection of these sets over the token tells
what the token may be: one script (a mixed token is re-spelled in it), several (a token made only of
shared shapes takes the script that the text's unambiguous tokens use most), or none (shared shapes
take the spelling of the first script that has them). As the sets depend on looks only, two texts
have the same form exactly when they look the same.

Looks are those of the table below, across scripts. Signs of one script that only resemble each other (1, l and I; 0 and O; rn
and m; dotted and dotless i) tell texts apart and keep their spelling: a form that merged them would not be readable text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import written

#: Letters of one look, each line ``look: script letters``; scripts in order of preference.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")
SAME_LOOK = """
A А Α - Ꭺ - ꓮ
B В Β - Ᏼ - ꓐ
C С Ϲ - Ꮯ Ⲥ ꓚ
D - - - Ꭰ - ꓓ
E Е Ε - Ꭼ - ꓰ
F - Ϝ - - - ꓝ
G Ԍ - - ᏀᏳ - ꓖ
H Н Η - Ꮋ Ⲏ ꓧ
I ІӀ Ι - - Ⲓ ꓲ
J Ј Ϳ - Ꭻ - ꓙ
K К Κ - Ꮶ Ⲕ ꓗ
L - - - Ꮮ - ꓡ
M М Μ - Ꮇ Ⲙ ꓟ
N - Ν - - Ⲛ ꓠ
O О Ο Օ - Ⲟ ꓳ
P Р Ρ - Ꮲ Ⲣ ꓑ
Q Ԛ - - - - -
R - - - ᎡᏒ - ꓣ
S Ѕ - Տ Ꮪ - ꓢ
T Т Τ - Ꭲ Ⲧ ꓔ
U - - Ս - - ꓴ
V Ѵ - - Ꮩ - ꓦ
W Ԝ - - Ꮃ - ꓪ
X Х Χ - - Ⲭ ꓫ
Y УҮ Υ - ᎽᎩ Ⲩ ꓬ
Z - Ζ - Ꮓ - ꓜ
aɑ а α - - - -
c с ϲ - - ⲥ -
d ԁ - - Ꮷ - -
e еҽ - - - - -
gɡ - - ց - - -
h һ - հ Ꮒ - -
i і ι - Ꭵ - -
j ј ϳ յ - - -
l ӏ - - - - -
n - - ոռ - - -
o о ο օ - ⲟ -
p р ρ - - ⲣ -
q ԛ - գզ - - -
s ѕ - - - - -
u - υ ս - - -
v ѵ ν - - - -
w ԝ - ա - - -
x х - - - - -
y уү γ - - - -
"""
#: Letters that are read as their look but that no token is re-spelled with.
ONLY_READ = set("ᎩᏳյӀԌԚԜѴҮԁҽһӏԛѵԝ")
#: Compatibility forms that only change the width, joining or style of a letter.
WIDTHS = {"wide", "narrow", "noBreak", "compat", "font", "initial", "medial", "final", "isolated"}
#: Invisible characters outside the format category.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Dashes and apostrophes of one look.
MARKS = {"‐": "-", "‑": "-", "﹣": "-", "ʼ": "’"}

_classes: list[dict[str, str]] = []
_class_of: dict[str, int] = {}
for _line in SAME_LOOK.split("\n"):
    if _line:
        _cells = _line.split(" ")
        for _letter in "".join(_cells).replace("-", ""):
            _class_of[_letter] = len(_classes)
        _classes.append({s: cell[0] for s, cell in zip(SCRIPTS, _cells, strict=True) if cell != "-" and cell[0] not in ONLY_READ})

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_script_re = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}
_scripts: dict[str, frozenset[str] | None] = {}
#: Tokens remembered per process, with the scripts that can spell them and their spellings; only speed depends on it.
MEMO_TOKENS = 200_000
_resolved: dict[str, tuple[str, ...]] = {}
_spelled: dict[tuple[str, str | None], str] = {}


def _visible(ch: str) -> str:
    """A character without its width: blanks as one blank, invisible ones as nothing."""
    category, code = unicodedata.category(ch), ord(ch)
    if ch in "\n\u2028\u2029\x85":
        return "\n"
    if category == "Zs" or ch in "\t\v\f":
        return " "
    if category in ("Cf", "Cc") or code in UNSEEN:
        return ""
    if ch in MARKS:
        return MARKS[ch]
    how = unicodedata.decomposition(ch)
    if how.startswith("<"):
        tag, *codes = how[1:].replace(">", "").split()
        if tag in WIDTHS and not (tag == "compat" and category in ("So", "Sk", "No")):
            return "".join(_visible(chr(int(c, 16))) for c in codes)
    return ch


class _Plain(dict):
    """Characters and what is seen of them, for ``str.translate``; filled as they come."""

    def __missing__(self, code: int) -> str:
        got = self[code] = _visible(chr(code))
        return got


_plain = _Plain()


def _spellable(ch: str) -> frozenset[str] | None:
    """The scripts that can spell this look; None for marks, which go with all."""
    if ch in _scripts:
        return _scripts[ch]
    if ch in _class_of:
        got = frozenset(_classes[_class_of[ch]])
    elif unicodedata.category(ch)[0] == "M":
        got = None
    else:
        got = frozenset(s for s, r in _script_re.items() if r.match(ch)) or frozenset(("other",))
    if len(_scripts) < 200_000:
        _scripts[ch] = got
    return got


def _resolve(token: str) -> tuple[str, ...]:
    """Scripts that can spell the whole token, in order of preference."""
    got = _resolved.get(token)
    if got is None:
        got = _intersect(token)
        if len(token) <= 64:
            if len(_resolved) >= MEMO_TOKENS:
                _resolved.clear()
            _resolved[token] = got
    return got


def _intersect(token: str) -> tuple[str, ...]:
    left: set[str] | None = None
    for ch in token:
        s = _spellable(ch)
        if s is not None:
            left = set(s) if left is None else left & s
            if not left:
                return ()
    return tuple(s for s in SCRIPTS if s in (left or ()))


def _spell(token: str, script: str | None) -> str:
    got = _spelled.get((token, script))
    if got is None:
        got = _respell(token, script)
        if len(token) <= 64:
            if len(_spelled) >= MEMO_TOKENS:
                _spelled.clear()
            _spelled[token, script] = got
    return got


def _respell(token: str, script: str | None) -> str:
    out = []
    for ch in token:
        k = _class_of.get(ch)
        forms = _classes[k] if k is not None else {}
        out.append(forms.get(script) or next(iter(forms.values())) if forms else ch)
    return "".join(out)


def consistent_form(text: str | None) -> str | None:
    """The form of a text: equal for texts that look the same, null for null.

    Case, visible punctuation, the number of blanks, visible accents and raised, small or squared
    characters are kept. Applying it twice changes nothing.
    """
    if text is None:
        return None
    if text.isascii():
        return text.translate(_plain) if not text.isprintable() else text
    flat = unicodedata.normalize("NFD", text.translate(_plain))
    tokens = Counter(_TOKEN.findall(flat))
    resolved = {t: _resolve(t) for t in tokens}
    votes: Counter[str] = Counter()
    for t, n in tokens.items():
        if len(resolved[t]) == 1:
            votes[resolved[t][0]] += n * len(t)
    order = sorted(SCRIPTS, key=lambda s: (-votes[s], SCRIPTS.index(s)))
    spelled = {t: _spell(t, next((s for s in order if s in r), None)) for t, r in resolved.items()}
    if any(t != x for t, x in spelled.items()):
        flat = _TOKEN.sub(lambda m: spelled[m.group()], flat)
    return unicodedata.normalize("NFC", flat)


#: Texts of printable ASCII and line feeds are their own form.
_NEEDS_WORK = r"[^\x20-\x7E\n]"


def with_form(df: DataFrame, text_col: str, form_col: str = "form") -> DataFrame:
    """df and ``form_col``. Plain ASCII rows never leave the JVM; others pass Python in Arrow batches.

    Null texts have a null form; empty ones an empty form. A column named ``form_col`` is replaced.
    """
    df = df.drop(form_col) if form_col != text_col else df
    at = df.columns.index(text_col)
    schema = df.withColumn(form_col, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([consistent_form(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*batch.schema.names, form_col])

    plain = df.filter(~F.coalesce(F.col(text_col).rlike(_NEEDS_WORK), F.lit(False)))
    return plain.withColumn(form_col, F.col(text_col)).unionByName(df.filter(F.col(text_col).rlike(_NEEDS_WORK)).mapInArrow(run, schema))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that are not blank: id, and 16 bytes each for the form and for the text as stored."""
    for batch in batches:
        keep, forms, texts = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            form = consistent_form(text)
            if form and not form.isspace():
                keep.append(i)
                forms.append(xxhash.xxh3_128_digest(form))
                texts.append(xxhash.xxh3_128_digest(text))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["id", "f", "t"])


def pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``{id}_a, {id}_b``: rows whose texts are stored otherwise but look the same, smaller id first.

    Null and blank texts have no pair; rows with a null id are no rows. Texts are read once. Different stored texts of one form are paired
    first, then each pair of texts takes its ids, so copies of one text never meet each other: the work follows the result.
    """
    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = written(rows.mapInArrow(_keys, f"id {df.schema[id_col].dataType.simpleString()}, f binary, t binary"), "lookalike-keys")
    kinds = keyed.select("f", "t").distinct()
    several = kinds.groupBy("f").agg(F.count("*").alias("k")).filter("k > 1").select("f")
    kinds = written(kinds.join(several, "f", "left_semi"), "lookalike-kinds")
    two = kinds.withColumnRenamed("t", "ta").join(kinds.withColumnRenamed("t", "tb"), "f").filter("ta < tb").select("ta", "tb")
    a, b = keyed.select(F.col("t").alias("ta"), F.col("id").alias("ia")), keyed.select(F.col("t").alias("tb"), F.col("id").alias("ib"))
    hit = two.join(a, "ta").join(b, "tb")
    return hit.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))
