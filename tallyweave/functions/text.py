"""Text scoring as Column expressions: no Python row ever runs, so scans stay inside code generation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L


#: A word character, its absence before and after, as Python's patterns understand them.
WORD = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_term(terms: Iterable[str]) -> str:
    """One pattern for any whole term, for lower-case texts. Terms are grouped by first letter, so most places of a text fail on one character."""
    by: dict[str, list[str]] = {}
    for t in terms:
        t = t.lower()
        by.setdefault(t[0], []).append(re.escape(t[1:]).replace(r"\-", "-").replace(r"\ ", " "))
    return START + "(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")" + END


def has_any(col: Column | str, terms: Iterable[str]) -> Column:
    """Whether a text has any of the terms as whole words, in any case; null counts as empty."""
    return F.lower(F.coalesce(_col(col), F.lit(""))).rlike(any_term(terms))


def has_pattern(col: Column | str, patterns: Iterable[str]) -> Column:
    return F.coalesce(_col(col), F.lit("")).rlike(f"(?iU){START}(?:" + "|".join(p.replace(r"\b", END) for p in patterns) + ")")


def word_list(col: Column | str) -> Column:
    """Words between Unicode blanks; null has none."""
    return F.filter(F.split(F.coalesce(_col(col), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(col: Column | str) -> Column:
    return F.size(word_list(col))


def quality(col: Column | str, verbs=L.VERBS, beneficiaries=L.BENEFICIARIES, activities=L.ACTIVITIES, boilerplate=L.BOILERPLATE, vague=L.VAGUE) -> Column:
    """Struct of the rubric's parts and their sum ``q``. Null counts as the empty text."""
    n = word_count(col)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    verb, who, what = has_any(col, verbs), has_any(col, beneficiaries), has_any(col, activities)
    clauses = F.length(F.regexp_replace(F.coalesce(_col(col), F.lit("")), "[^.;,]", ""))
    parts = {
        "s_len": F.when(n < 4, 0.0).when(n <= 7, 0.5).when(n <= 14, 1.0).otherwise(1.5),
        "f_purpose": flag(verb), "f_benef": flag(who), "f_acts": flag(what), "f_specific": flag(who & what),
        "s_clause": F.when(clauses >= 2, 0.5).otherwise(0.0),
        "penalties": F.when(has_pattern(col, boilerplate), -1.5).otherwise(0.0) + F.when(has_pattern(col, vague) & (n < 15), -2.0).otherwise(0.0) + F.when(n < 4, -1.0).otherwise(0.0),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(total.alias("q"), *[c.alias(k) for k, c in parts.items()])


def tier(q: Column | str, high: float = 5.0, medium: float = 3.0) -> Column:
    return F.when(_col(q) >= high, "HIGH").when(_col(q) >= medium, "MEDIUM").otherwise("LOW")


def rule_label(col: Column | str, strong=L.STRONG, religious=L.RELIGIOUS) -> Column:
    """1 for a strong term, 0 for a short text without any term, else null."""
    return F.when(has_any(col, strong), 1).when((word_count(col) < 6) & ~has_any(col, religious), 0)


def positive_rescue(col: Column | str, q: Column | str, strong=L.STRONG, verbs=L.VERBS) -> Column:
    return (_col(q) >= 4.5) & (_col(q) < 5.0) & has_any(col, strong) & has_any(col, verbs)


def route(col: Column | str, tier_col: Column | str, low_to_rules: bool = True, ambiguous_to_classifier: bool = True, **lists) -> Column:
    """Struct (source, label): where a row's label comes from, and the label if a rule gives it."""
    low = F.upper(F.trim(_col(tier_col))) == "LOW"
    rule = rule_label(col, **lists)
    rest = "low_via_classifier" if ambiguous_to_classifier else "rule_abstain"
    source = F.when(~F.coalesce(low, F.lit(False)) | F.lit(not low_to_rules), "classifier").when(rule == 1, "rule_strong_positive").when(rule == 0, "rule_short_negative").otherwise(rest)
    return F.struct(source.alias("source"), F.when(source.startswith("rule_"), rule).alias("label"))


def boundary_class(col: Column | str) -> Column:
    """First boundary class that fits (see ``lexicon.BOUNDARY``), else none."""
    t = F.lower(F.coalesce(_col(col), F.lit("")))
    has = lambda p: t.rlike(rf"(?U){START}(?:{p})".replace(r"\w", WORD).replace(r"\b", END))
    out = F.lit("none")
    for name, pattern, without in reversed(L.BOUNDARY):
        fits = has(pattern) & ~has(f"(?:{'|'.join(without)})\\b") if without else has(pattern)
        out = F.when(fits, name).otherwise(out)
    return out


def group_letter(code: Column | str) -> Column:
    """First letter of a taxonomy code, upper case; ``?`` for null, blank and malformed codes."""
    c = F.upper(F.substring(F.trim(_col(code)), 1, 1))
    return F.when(c.rlike("^[A-Z]$"), c).otherwise("?")


def truncation_flag(col: Column | str, limit: int = 995) -> Column:
    """A text of ``limit`` characters or more without a closing mark; false for null."""
    t = F.trim(F.coalesce(_col(col), F.lit("")))
    return (F.length(F.coalesce(_col(col), F.lit(""))) >= limit) & ~t.rlike("[.!?]$")


def length_bin(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n <= 10, "0-10").when(n <= 25, "11-25").when(n <= 50, "26-50").otherwise("51+")


def text_key(col: Column | str, missing: str = "\u0000missing") -> Column:
    """Join key of a text in which null and the empty text stay different."""
    return F.coalesce(_col(col), F.lit(missing))


def tokens(col: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """Lower-case words of two characters or more, stop words taken out before n-grams are formed."""
    t = F.regexp_extract_all(F.lower(F.coalesce(_col(col), F.lit(""))), F.lit(WORD + "{2,}"), F.lit(0))
    stop = list(stopwords)
    return F.filter(t, lambda x: ~x.isin(stop)) if stop else t


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of low to high words, joined by blanks. Shifted arrays are zipped, so the work is linear in the words."""
    size = F.size(words)
    parts, grams = [], words
    for n in range(1, high + 1):
        if n > 1:
            shifted = F.slice(words, F.lit(n), F.greatest(size - (n - 1), F.lit(0)))
            grams = F.slice(F.zip_with(grams, shifted, lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
        if n >= low:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def source_parts(col: Column | str) -> Column:
    """Struct (model_id, prompt_id) of a source id, split at its last double underscore."""
    c = _col(col)
    prompt = F.substring_index(c, "__", -1)
    return F.struct(F.substring(c, F.lit(1), F.length(c) - F.length(prompt) - 2).alias("model_id"), prompt.alias("prompt_id"))


def slug(col: Column | str) -> Column:
    return F.regexp_replace(_col(col), r"[^A-Za-z0-9_.-]+", "__")


def strip_fence(col: Column | str) -> Column:
    """JSON without a Markdown code fence around it."""
    return F.regexp_replace(F.trim(_col(col)), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")


def clean_name(col: Column | str, strip_suffix: bool = True, suffixes=L.SUFFIXES, acronyms=L.ACRONYMS) -> Column:
    """A name with first letters raised, acronyms kept and, if asked, legal suffixes taken off; null is empty."""
    c = F.regexp_replace(F.trim(F.coalesce(_col(col), F.lit(""))), r"(?U)\s+", " ")
    if strip_suffix:
        ends = "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True))
        c = F.regexp_replace(c, rf"(?i)(?:[\s,]+(?:{ends})\.?)+$", "")
        c = F.regexp_replace(c, r"^[ ,.;:]+|[ ,.;:]+$", "")
    keep = list(acronyms)
    cased = F.transform(F.split(c, " "), lambda w: F.when(F.upper(w).isin(keep), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))))
    return F.array_join(cased, " ")


def name_tokens(col: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(col), F.lit("")), F.lit(r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"), F.lit(0))


def lexicon_tokens(col: Column | str, words: Iterable[str]) -> Column:
    """Sorted distinct lower-case name tokens that belong to a lexicon (its phrases split into words)."""
    known = sorted({w.lower() for t in words for w in t.split()})
    return F.sort_array(F.array_distinct(F.filter(F.transform(name_tokens(col), F.lower), lambda x: x.isin(known))))


def conflict_categories(name: Column | str, no_flags: Column) -> Column:
    """Review cues of a name, as an array; a saint's name counts only where no external flag is set."""
    c = F.coalesce(_col(name), F.lit(""))
    has = lambda p: c.rlike(r"(?iU)" + p.replace(r"\b(?:", START + "(?:").replace(r"\b", END).replace(r"\w", WORD))
    cues = [(k, has(p) & no_flags if k == "saint_name" else has(p)) for k, p in L.CUES]
    return F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in cues]))
