"""The queries in SQL for another engine (RE2 patterns, no lookaround), written independently of the operators."""

from __future__ import annotations

from tallyweave.functions import lexicon as L
from tallyweave.operators.keyness import STOPWORDS
from tallyweave.plans.queries import GREEDY

#: The sources of the store in these tables. The query takes its sources from the data, so another one would show as a difference.
SOURCES = [f"{m}__{p}" for m in ("aspen-large", "birch-mini", "cedar-27b", "dogwood-nano") for p in ("v1", "v2", "v3")] + ["elder-flash__v1", "elder-flash__v2", "lexicon-rule__r4"]

W = r"\p{L}\p{N}_"
BLANK = r"[\s\p{Z}\x0b\x{85}]"


def nine(c: str = "EIN2") -> str:
    d = f"regexp_replace(regexp_replace(trim({c}), '\\.0+$', ''), '[^0-9]', '', 'g')"
    return f"case when length({d}) between 1 and 9 then lpad({d}, 9, '0') end"


def std(c: str = "EIN2") -> str:
    return f"'EIN-' || substr({nine(c)}, 1, 2) || '-' || substr({nine(c)}, 3)"


def pri(seed: int, c: str) -> str:
    return f"cast('0x' || substr(sha256('{seed}:' || {c}), 1, 15) as bigint)"


def hit(c: str, words) -> str:
    p = "|".join(w.replace("'", "''") for w in words)
    return f"regexp_matches(coalesce({c}, ''), '(^|[^{W}])({p})([^{W}]|$)', 'i')"


def pat(c: str, patterns) -> str:
    p = "|".join(x.replace(r"\s", BLANK).replace(r"\b", f"([^{W}]|$)") for x in patterns)
    return f"regexp_matches(coalesce({c}, ''), '(^|[^{W}])({p})', 'i')"


def n_words(c: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({c}, ''), '{BLANK}+'), lambda x: x <> ''))"


def letter(c: str) -> str:
    return f"case when regexp_matches(upper(substr(trim({c}), 1, 1)), '^[A-Z]$') then upper(substr(trim({c}), 1, 1)) else '?' end"


REL, STRONG, VERBS, BEN, ACT = (L.RELIGIOUS, L.STRONG, L.VERBS, L.BENEFICIARIES, L.ACTIVITIES)


def quality(c: str) -> dict[str, str]:
    n = n_words(c)
    f = lambda x: f"case when {x} then 1.0::double else 0.0::double end"
    parts = {
        "s_len": f"case when {n} < 4 then 0.0::double when {n} <= 7 then 0.5::double when {n} <= 14 then 1.0::double else 1.5::double end",
        "f_purpose": f(hit(c, VERBS)), "f_benef": f(hit(c, BEN)), "f_acts": f(hit(c, ACT)), "f_specific": f(f"{hit(c, BEN)} and {hit(c, ACT)}"),
        "s_clause": f"case when length(regexp_replace(coalesce({c}, ''), '[^.;,]', '', 'g')) >= 2 then 0.5::double else 0.0::double end",
        "penalties": f"(case when {pat(c, L.BOILERPLATE)} then -1.5::double else 0.0::double end + case when {pat(c, L.VAGUE)} and {n} < 15 then -2.0::double else 0.0::double end + case when {n} < 4 then -1.0::double else 0.0::double end)",
    }
    return {"q": " + ".join(f"({x})" for x in parts.values())} | parts


def tier(q: str) -> str:
    return f"case when {q} >= 5 then 'HIGH' when {q} >= 3 then 'MEDIUM' else 'LOW' end"


def rule(c: str) -> str:
    return f"case when {hit(c, STRONG)} then 1 when {n_words(c)} < 6 and not {hit(c, REL)} then 0 end"


def boundary(c: str) -> str:
    has = lambda p: f"regexp_matches(lower(coalesce({c}, '')), '(^|[^{W}])({p})')"
    w = lambda p: f"({p})([^{W}]|$)"
    s = f"{BLANK}+[{W}]"
    core = "christ|christian|jesus|gospel|bible|church|synagogue|mosque|temple"
    return (
        f"case when {has(f'st[.]?{s}|saint{s}')} and not {has(w('church|diocese|catholic|parish|christian'))} then 'saint' "
        f"when {has(w('spiritual'))} and not {has(w(core + '|islam|muslim|jewish|hindu|buddhist'))} then 'spiritual' "
        f"when {has(w('ministry|ministries'))} and not {has(w('|'.join(STRONG)))} then 'ministry' "
        f"when {has(w('faith|judeo-christian'))} and not {has(w(core))} then 'faith_heritage' "
        f"when {has(w(f'religious,{BLANK}+charitable{BLANK}+and{BLANK}+educational'))} then 'boilerplate_religious' else 'none' end"
    )


CODES = f"codes as (select {nine()} as k, min(NTEE_IRS) as code from registry where {nine()} is not null group by 1)"
FRAME = f"""{CODES}, frame as (select rec_id, {std('m.EIN2')} as EIN2, LONGEST_MISSION as mission_text, code, {letter('code')} as ntee_major_group,
  length(coalesce(LONGEST_MISSION, '')) >= 995 and not regexp_matches(trim(coalesce(LONGEST_MISSION, '')), '[.!?]$') as is_truncated, 'corpus' as data_source
  from mission_frame m left join codes on codes.k = {nine('m.EIN2')})"""
_W = "regexp_replace(lower(binary_label), '[^a-z]', '', 'g')"
VOTES = f"""raw_votes as (select {std()} as EIN2, model_id || '__' || prompt_id as source_id, source_type, model_id, prompt_id,
  case when {_W} = 'religious' then 1 when {_W} in ('nonreligious', 'notreligious') then 0 end as label,
  case when confidence > 1 then confidence / 100 else confidence end as confidence, run_timestamp, binary_label, evidence_spans, domains_present, system_fingerprint
  from label_record where error is null and {nine()} is not null),
votes as (select * from raw_votes qualify row_number() over (partition by EIN2, source_id order by run_timestamp desc nulls last, coalesce(cast(label as varchar), ''), coalesce(cast(confidence as varchar), ''), coalesce(binary_label, ''), coalesce(evidence_spans, ''), coalesce(domains_present, ''), coalesce(system_fingerprint, '')) = 1)"""
MAJ = """maj as (select EIN2, count(*) filter (where label = 1) as n1, count(*) filter (where label = 0) as n0, count(*) filter (where label is null) as num_abstain,
  avg(confidence) filter (where label = 1) as c1, avg(confidence) filter (where label = 0) as c0 from votes group by 1),
majority as (select EIN2, case when n1 > n0 then 1 when n0 > n1 then 0 end as label, case when n1 > n0 then c1 when n0 > n1 then c0 end as confidence, n1 + n0 as num_votes, num_abstain,
  case when n1 + n0 > 0 then greatest(n1, n0) / (n1 + n0) end as agreement, n1 = n0 and n1 > 0 as tie from maj)"""
SCORED = f"""{VOTES}, grps as (select {std()} as EIN2, {letter('NTEE_IRS')} as grp from registry where {nine()} is not null),
shares as (select EIN2, round(avg(label::double), 6) as p from votes where source_type = 'llm_prompt' and label is not null group by 1),
scored as (select s.EIN2, p, coalesce(grp, '?') as grp from shares s left join grps g on g.EIN2 = s.EIN2)"""
EVAL = f"""{SCORED}, truth as (select EIN2, max(label) as y from votes where source_type = 'rule' and label is not null group by 1),
ev as (select s.EIN2, y, p, (p >= 0.5)::int as pred, grp, ({pri(3, 's.EIN2')} % 3 + 1) / 4 as sample_prob, 1 / (({pri(3, 's.EIN2')} % 3 + 1) / 4) as w from scored s join truth t on t.EIN2 = s.EIN2)"""
SAMPLE = f"""sam as (select sample_id, case when {nine()} is not null then {std()} end as EIN2, mission_text, {letter('ntee_major_group')} as grp, coalesce(nullif(upper(trim(tier)), ''), 'UNKNOWN') as tier,
  Q, split, data_source, ({pri(5, 'sample_id')} % 1000) / 1000 as p from mission_sample)"""
TEXTS = f"texts as (select {std()} as EIN2, LONGEST_MISSION as t from mission_frame where {nine()} is not null union all select {std()}, mission_text from mission_sample where {nine()} is not null)"
SPANS = f"""{VOTES}, {TEXTS}, spans as (select distinct EIN2, source_id, unnest(from_json(evidence_spans, '["varchar"]')) as span from votes where evidence_spans is not null),
verified as (select s.EIN2, s.source_id, s.span, max(case when t.t is null then null else contains(t.t, s.span)::int end) as hit from (select * from spans where trim(span) <> '') s left join texts t on t.EIN2 = s.EIN2 and t.t is not null group by 1, 2, 3)"""

ROUTE = f"case when tier <> 'LOW' then 'classifier' when ({rule('mission_text')}) = 1 then 'rule_strong_positive' when ({rule('mission_text')}) = 0 then 'rule_short_negative' else 'low_via_classifier' end"
BUNDLE = """tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1,
round(case when sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn) = 0 then 0 else (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) end, 6) as mcc,
round((case when tp + fn = 0 then 0 else tp / (tp + fn) end + case when tn + fp = 0 then 0 else tn / (tn + fp) end) / 2, 6) as balanced_accuracy,
round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 6) as kappa, round(case when n = 0 then null when pos in (0, 1) then (po = 1)::int::double else 1 - (1 - po) / (2 * pos * (1 - pos)) end, 6) as alpha"""
CELLS = "count(*) filter (where y = 0 and {p} = 0) as tn, count(*) filter (where y = 0 and {p} = 1) as fp, count(*) filter (where y = 1 and {p} = 0) as fn, count(*) filter (where y = 1 and {p} = 1) as tp"
EXTRA = "*, tp + fp + fn + tn as n, case when tp + fp + fn + tn = 0 then 0 else (tp + tn) / (tp + fp + fn + tn) end as po, case when tp + fp + fn + tn = 0 then 0 else ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) end as pe, case when tp + fp + fn + tn = 0 then 0 else (2 * tp + fp + fn) / (2 * (tp + fp + fn + tn)) end as pos"
CURVE = f"""{EVAL}, pts as (select p as threshold, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from ev group by 1),
cum as (select threshold, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over () as np, sum(neg) over () as nn from pts window d as (order by threshold desc rows unbounded preceding)),
curve as (select threshold, tp::bigint as tp, fp::bigint as fp, (np - tp)::bigint as fn, np, nn, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when np = 0 then 0 else tp / np end as recall, case when tp + fp + np = 0 then 0 else 2 * tp / (tp + fp + np) end as f1 from cum)"""
BASE = f"""{EVAL}, pts as (select p as threshold, sum(case when y = 1 then w else 0 end) as wp, sum(case when y = 0 then w else 0 end) as wn from ev group by 1),
rates as (select threshold, coalesce(sum(wp) over d / nullif(sum(wp) over (), 0), 0) as tpr, coalesce(sum(wn) over d / nullif(sum(wn) over (), 0), 0) as fpr from pts window d as (order by threshold desc rows unbounded preceding)),
base as (select threshold, tpr, fpr, case when tpr * 0.2 + fpr * 0.8 = 0 then 0 else tpr * 0.2 / (tpr * 0.2 + fpr * 0.8) end as precision from rates)"""
WILSON = lambda s, n, sign: f"case when {n} > 0 then least(1, greatest(0, ({s} / {n} + 1.959963984540054 * 1.959963984540054 / (2 * {n})) / (1 + 1.959963984540054 * 1.959963984540054 / {n}) {sign} 1.959963984540054 * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + 1.959963984540054 * 1.959963984540054 / (4 * {n} * {n})) / (1 + 1.959963984540054 * 1.959963984540054 / {n}))) end"
Z = "1.959963984540054"


def ranked(cols: str, id_col: str, seed: int, where: str = "true") -> str:
    return f"rk as (select *, row_number() over (partition by {cols} order by {pri(seed, id_col)}, {id_col}) as rank, count(*) over (partition by {cols}) as size from sam where {where})"


def ppi(by: str = "", weight: str = "1.0::double") -> str:
    g, on = (f"{by}, " if by else ""), (f"using ({by})" if by else "on true")
    group = f"group by {by}" if by else ""
    return f"""a as (select {g}count(*) as n_anchor, sum(w) * sum(w) / sum(w * w) as n, sum(w * y) / sum(w) as my, sum(w * p) / sum(w) as mx, sum(w * y * p) / sum(w) as yx, sum(w * p * p) / sum(w) as xx, sum(w * y * y) / sum(w) as yy from (select EIN2, grp, y, p, {weight} as w from ev) {group}),
c as (select {g}count(*)::double as big, avg(p) as mp, greatest(avg(p * p) - avg(p) * avg(p), 0) as vp from scored {group}),
l as (select *, yx - my * mx as cov, greatest(xx - mx * mx, 0) as vx, greatest(yy - my * my, 0) as vy from a join c {on}),
t as (select *, coalesce(least(1, greatest(0, cov / nullif((1 + n / big) * vx, 0))), 0) as lam from l),
est as (select *, lam * mp + my - lam * mx as e, lam * lam * vp / big + greatest(vy - 2 * lam * cov + lam * lam * vx, 0) / n as v from t)"""


PPI_OUT = f"n_anchor, big as n_corpus, round(lam, 6) as tuning, round(least(1, greatest(0, e)), 6) as estimate, round(v, 6) as variance, round(least(1, greatest(0, e - {Z} * sqrt(v))), 6) as ci_lower, round(least(1, greatest(0, e + {Z} * sqrt(v))), 6) as ci_upper"


def terms_sql(weight: str, low: int = 1, high: int = 1) -> str:
    stop = ", ".join(f"'{s}'" for s in STOPWORDS)
    toks = f"list_filter(regexp_extract_all(lower(mission_text), '[{W}]{{2,}}'), lambda x: x not in ({stop}))"
    grams = "toks" if high == 1 else "list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])"
    return f"""{SAMPLE}, tk as (select sample_id, ({weight})::double as w, {toks} as toks from sam where mission_text is not null),
ex as (select sample_id, w, unnest({grams}) as term from tk),
tf as (select sample_id, w, term, count(*) as k from ex group by 1, 2, 3),
tc as (select term, sum(k * w) as positive_count, sum(k * (1 - w)) as negative_count, count(*) as document_frequency from tf group by 1)"""


def keyness_sql(weight: str) -> str:
    return f"""{terms_sql(weight)}, kept as (select * from tc where document_frequency >= 5), tot as (select sum(positive_count) as pt, sum(negative_count) as nt, count(*) as v from kept),
al as (select *, (positive_count + negative_count) * v / (pt + nt) as a from kept, tot),
ky as (select term, round((ln((positive_count + a) / (pt + v - positive_count - a)) - ln((negative_count + a) / (nt + v - negative_count - a))) / sqrt(1 / (positive_count + a) + 1 / (negative_count + a)), 5) as z_score,
 round(log2(((positive_count + 0.5) / (pt + 0.5 * v)) / ((negative_count + 0.5) / (nt + 0.5 * v))), 5) as log2_rate_ratio, round(ln((positive_count + 1) / (pt + v)) - ln((negative_count + 1) / (nt + v)), 5) as log_odds,
 round(positive_count, 5) as positive_count, round(negative_count, 5) as negative_count, round(positive_count + negative_count, 5) as total_count, document_frequency, round(positive_count / pt, 5) as positive_rate, round(negative_count / nt, 5) as negative_rate from al)"""


_NAME = f"trim(regexp_replace(coalesce(ORG_NAME_CURRENT, ''), '{BLANK}+', ' ', 'g'))"
_SUF = "|".join(s.replace(".", "[.]") for s in sorted(L.SUFFIXES, key=len, reverse=True))


def cased(c: str) -> str:
    keep = ", ".join(f"'{a}'" for a in L.ACRONYMS)
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: case when upper(w) in ({keep}) then upper(w) else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end), ' ')"


def bare(suffixes: str) -> str:
    return f"regexp_replace(regexp_replace({_NAME}, '([{BLANK[1:-1]},]+({suffixes})[.]?)+$', '', 'i'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


_BARE = bare(_SUF)
_GREEDY = bare("|".join(s.replace(".", "[.]") for s in sorted((*L.SUFFIXES, *GREEDY), key=len, reverse=True)))
NAMED = f"""named as (select *, {cased('bare')} as name_cleaned, {cased('flat')} as name_with_suffix, coalesce(starts_with(upper(trim(NTEE_IRS)), 'X'), false) as x, coalesce(try_cast(trim(BMF_FOUNDATION_CODE) as double) = 10, false) as c
  from (select *, {_NAME} as flat, {_BARE} as bare from registry)), stra as (select *, case when x and c then 'both_external_flags' when x then 'ntee_x_only' when c then 'church_foundation_only' else 'neither_external_flag' end as stratum from named)"""


def lex_tokens(c: str, words) -> str:
    known = ", ".join(f"'{w}'" for w in sorted({w for t in words for w in t.split()}))
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'), lambda w: lower(w)), lambda x: x in ({known}))))"


Q = quality("mission_text")


def oracle_sql() -> dict[str, str]:
    cm = f"ev_cells as (select {CELLS.format(p='pred')} from ev)"
    shard = {
        "corpus_rows": f"with {FRAME} select rec_id, EIN2, code, ntee_major_group, is_truncated, data_source from frame",
        "corpus_dedup": f"with {FRAME} select rec_id, EIN2, ntee_major_group from frame qualify row_number() over (partition by mission_text order by rec_id) = 1",
        "text_multiplicity": "select md5(coalesce(LONGEST_MISSION, chr(0) || 'missing')) as text_md5, count(*) as n_rows from mission_frame group by LONGEST_MISSION",
        "expand_back": f"with {FRAME} select rec_id, {tier(Q['q'])} as tier, min(rec_id) over (partition by mission_text) as from_rec from frame",
        "quality_components": f"with {FRAME} select rec_id, {', '.join(f'{x} as {k}' for k, x in Q.items())} from frame",
        "quality_tier_by_group": f"with {FRAME}, s as (select ntee_major_group, {Q['q']} as q from frame) select ntee_major_group, {tier('q')} as tier, count(*) as n, round(avg(q), 6) as mean_q from s group by 1, 2",
        "rule_label_route": f"with {SAMPLE}, x as (select tier, {ROUTE} as source from sam) select tier, source, case source when 'rule_strong_positive' then 1 when 'rule_short_negative' then 0 end as label, count(*) as n from x group by all",
        "rule_labels": f"with {SAMPLE} select sample_id, {rule('mission_text')} as label from sam",
        "lexicon_hits": f"select sample_id, {hit('mission_text', REL)} as religious, {hit('mission_text', STRONG)} as strong, {hit('mission_text', VERBS)} as verb from mission_sample",
        "positive_rescue": f"with s as (select sample_id, mission_text, {Q['q']} as q from (select sample_id, mission_text from mission_sample union all values (-1, 'We provide church meals for children weekly'), (-2, 'We provide warm meals for children weekly'), (-3, 'We provide church meals for children weekly and monthly'))) select sample_id, q from s where q >= 4.5 and q < 5 and {hit('mission_text', STRONG)} and {hit('mission_text', VERBS)}",
        "boundary_classes": f"select {boundary('mission_text')} as boundary, count(*) as n from mission_sample group by 1",
        "length_bins": f"with x as (select {n_words('mission_text')} as k from mission_sample) select case when k <= 10 then '0-10' when k <= 25 then '11-25' when k <= 50 then '26-50' else '51+' end as length_bin, count(*) as n from x group by 1",
        "scope_filter": "select data_source, COMMON_LEVEL1, count(*) as n from mission_frame where trim(COMMON_LEVEL1) in ('501C3 CHARITY', '501C3 PRIVATE FOUNDATION') and trim(LONGEST_MISSION) <> '' group by 1, 2",
        "group_labels": f"with {FRAME}, t(grp, label) as (values {', '.join(f'''('{k}', '{v}')''' for k, v in L.GROUPS.items())}), n as (select case when ntee_major_group = '?' then 'Z' else ntee_major_group end as grp, count(*) as n from frame group by 1) select t.grp, label, coalesce(n, 0) as n from t left join n on n.grp = t.grp",
        "id_spellings": f"select {std()} as EIN2, count(distinct EIN2) as n_spellings, count(*) as n_rows from mission_sample where EIN2 is not null group by {std()} having count(distinct EIN2) > 1",
        "completeness": f"with {SAMPLE}, {FRAME}, a as (select EIN2, count(*) as na from sam group by 1), b as (select EIN2, count(*) as nb from frame group by 1) select coalesce(sum(na), 0)::bigint as n_left, coalesce(sum(nb), 0)::bigint as n_right, count(*) filter (where nb is null) as n_missing, count(*) filter (where na is null) as n_extra, count(*) filter (where na > 1 or nb > 1) as n_repeated from a full join b on a.EIN2 is not distinct from b.EIN2",
        "overlapping_ids": f"with {SAMPLE} select EIN2 from sam where split = 'train' and EIN2 is not null intersect select EIN2 from sam where split <> 'train'",
        "repeated_ids": f"with {FRAME} select EIN2, count(*) as n_rows from frame group by 1 having count(*) > 1",
        "varying_fields": f"with x as (select {std()} as EIN2, coalesce(COMMON_LEVEL1, chr(0)) as a, coalesce(data_source, chr(0)) as b from mission_frame) select EIN2, count(distinct a) as n_COMMON_LEVEL1, count(distinct b) as n_data_source from x group by 1 having count(distinct a) > 1 or count(distinct b) > 1",
        "ids_not_annotated": f"with {SAMPLE}, {FRAME}, {VOTES} select EIN2 from (select EIN2 from sam union select EIN2 from frame) where EIN2 is not null and EIN2 not in (select EIN2 from votes)",
        "ids_annotated": f"with {SAMPLE}, {FRAME}, {VOTES} select EIN2 from (select EIN2 from sam union select EIN2 from frame) where EIN2 in (select EIN2 from votes)",
        "longest_value": f"select {std()} as EIN2, LONGEST_MISSION_SOURCE_YEAR as year, md5(coalesce(LONGEST_MISSION, '')) as text_md5 from mission_frame qualify row_number() over (partition by {std()} order by coalesce(length(trim(LONGEST_MISSION)), -1) desc, coalesce(LONGEST_MISSION_SOURCE_YEAR, -1) desc, coalesce(LONGEST_MISSION, '')) = 1",
        "strict_binary": "select case label when 1 then 1 when 0 then 0 end as v, label is null as missing, count(*) as n from label_record group by 1, 2",
        "domain_checks": f"with {SAMPLE}, v as (select count(*) as n_votes, count(*) filter (where confidence > 1) as n_percent, count(*) filter (where EIN2 is null) as n_no_id, count(*) filter (where error is not null) as n_failed from label_record), s as (select count(*) filter (where tier not in ('HIGH', 'MEDIUM', 'LOW')) as n_bad_tier, count(*) filter (where grp = '?') as n_no_group, count(*) filter (where Q is null) as n_no_q from sam) select * from v, s",
        "source_counts_before": f"with {FRAME}, n as (select ntee_major_group, count(*) as n from frame group by 1) select ntee_major_group, n, coalesce(sum(n) over (order by ntee_major_group rows between unbounded preceding and 1 preceding), 0)::bigint as total_before from n",
        "term_slugs": "select distinct model_id || '__' || prompt_id as source_id, regexp_replace(model_id || '__' || prompt_id || ' / x', '[^A-Za-z0-9_.-]+', '__', 'g') as slug, model_id, prompt_id from label_record",
        "latest_votes": f"with {VOTES} select EIN2, source_id, label, confidence, epoch_us(run_timestamp) as run_us from votes",
        "majority_vote": f"with {VOTES}, {MAJ} select EIN2, label, round(confidence, 6) as confidence, num_votes, num_abstain, round(agreement, 6) as agreement, tie from majority",
        "vote_share": f"with {VOTES} select EIN2, round(avg(label::double), 6) as p_pos, count(*) as n_votes from votes where label in (0, 1) group by 1",
        "label_matrix": f"with {VOTES} select EIN2, {', '.join(f'''max(label) filter (where source_id = '{s}') as "{s}"''' for s in SOURCES)} from votes group by 1",
        "label_stack": f"with {VOTES} select source_id, count(*) as n, sum(label)::bigint as n_positive from votes where label is not null group by 1",
        "consensus_agreement": f"with {VOTES}, {MAJ} select v.EIN2, round(avg((v.label = m.label)::int::double), 6) as agreement from votes v join majority m on m.EIN2 = v.EIN2 where v.label is not null group by 1",
        "pairwise_agreement": f"with {VOTES} select a.source_id as source_a, b.source_id as source_b, count(*) as n_common, round(avg((a.label = b.label)::int::double), 6) as agreement from votes a join votes b on a.EIN2 = b.EIN2 and a.source_id < b.source_id where a.label is not null and b.label is not null group by 1, 2",
        "source_summary": f"with {VOTES} select source_id, count(*) as n_rows, count(*) filter (where label is null) as n_abstain, round(count(*) filter (where label is null) / count(*), 6) as abstain_rate, round(avg(label::double), 6) as positive_rate from votes group by 1",
        "vote_histogram": f"with {VOTES}, {MAJ} select num_votes, count(*) as n_records, count(*) filter (where tie) as n_tied from majority group by 1",
        "pending_pairs": f"with {VOTES} select s.source_id, count(*) as n_pending from (select distinct EIN2 from votes) e, (select distinct source_id from votes) s where not exists (select 1 from votes v where v.EIN2 = e.EIN2 and v.source_id = s.source_id) group by 1",
        "fingerprints": f"with {VOTES} select source_id, string_agg(distinct system_fingerprint, ',' order by system_fingerprint) as fingerprints from votes where system_fingerprint is not null group by 1",
        "drift": f"with {VOTES}, c as (select count(*) filter (where a.label = 1 and b.label = 1) as tp, count(*) filter (where a.label = 0 and b.label = 1) as fp, count(*) filter (where a.label = 1 and b.label = 0) as fn, count(*) filter (where a.label = 0 and b.label = 0) as tn from votes a join votes b on a.EIN2 = b.EIN2 where a.source_id = 'aspen-large__v1' and b.source_id = 'aspen-large__v2' and a.label is not null and b.label is not null), e as (select {EXTRA} from c), o as (select n, fp, fn, {BUNDLE} from e) select n as n_common, fp + fn as n_changed, kappa, alpha from o".replace("select n, fp, fn, tp, fp, fn, tn,", "select n, tp, fp, fn, tn,"),
        "set_hash": f"with {VOTES} select source_id, sha256(string_agg(distinct EIN2, chr(10) order by EIN2)) as set_hash, count(distinct EIN2) as n_ids from votes group by 1",
        "first_audit": f"with {VOTES} select model_id, source_id, EIN2, epoch_us(run_timestamp) as us from votes qualify row_number() over (partition by model_id order by run_timestamp nulls last, source_id, EIN2) = 1",
        "arms_against_rule": f"with {EVAL}, c as (select source_id, count(*) as n, count(*) filter (where label is null) as na, count(*) filter (where label = 1 and y = 1) as tp, count(*) filter (where label = 1 and y = 0) as fp, count(*) filter (where label = 0 and y = 1) as fn from votes v join ev on ev.EIN2 = v.EIN2 group by 1) select source_id, n, round(na / n, 6) as abstain_rate, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c",
        "parse_answers": "with x as (select case when confidence > 1 then 'malformed JSON' when confidence > 0.9 then 'missing keys: boundary_notes, confidence, domains_present, evidence_spans, reason' when binary_label is null or binary_label not in ('religious', 'nonreligious', 'ambiguous_review', 'insufficient_information') then 'invalid label: ' || coalesce(binary_label, 'null') end as parse_error, binary_label from label_record) select case when parse_error is null then case binary_label when 'religious' then 1 when 'nonreligious' then 0 end end as label, parse_error, count(*) as n from x group by 1, 2",
        "evidence_spans": f"with {SPANS} select source_id, count(*) as n_spans, count(*) filter (where hit = 1) as n_verbatim, count(*) filter (where hit is null) as n_no_text, round(count(*) filter (where hit = 1) / nullif(count(hit), 0), 6) as verbatim_rate from verified group by 1",
        "abstain_fabricated": f"with {SPANS}, x as (select v.source_id, case when v.label = 1 and exists (select 1 from verified f where f.EIN2 = v.EIN2 and f.source_id = v.source_id and hit = 0) then null else v.label end as label from votes v) select source_id, label, count(*) as n from x group by 1, 2",
        "domains": f"with {VOTES}, x as (select source_type, unnest(from_json(domains_present, '[\"varchar\"]')) as domain from votes where domains_present is not null) select source_type, domain, count(*) as n from x group by 1, 2",
        "backfilled_text": f"with {TEXTS}, l as (select EIN2, min(t) as t from texts where t is not null group by 1), v as (select {std()} as EIN2, text as t from label_record where {nine()} is not null) select v.EIN2, count(*) as n_rows, count(coalesce(v.t, l.t)) as n_with_text from v left join l on l.EIN2 = v.EIN2 group by 1",
        "confusion_matrix": f"with {EVAL} select {CELLS.format(p='pred')} from ev",
        "threshold_confusion": f"with {EVAL}, t(name, threshold) as (values ('operating', 0.3::double), ('base_rate', 0.5::double), ('max_f1', 0.7::double)) select name, threshold, {CELLS.format(p='(p >= threshold)::int')} from ev, t group by 1, 2",
        "metric_bundle": f"with {EVAL}, {cm}, e as (select {EXTRA} from ev_cells) select {BUNDLE} from e",
        "metric_bundle_by_source": f"with {EVAL}, c as (select source_id, {CELLS.format(p='label')} from votes v join ev on ev.EIN2 = v.EIN2 where label is not null group by 1), e as (select {EXTRA} from c) select source_id, {BUNDLE} from e",
        "subgroup_report": f"with {EVAL}, {TEXTS}, mt as (select EIN2, max(t) as text from texts where t is not null group by 1), j as (select ev.*, {n_words('text')} as k from ev left join mt on mt.EIN2 = ev.EIN2), g as (select 'grp' as \"column\", grp as value, y, pred from j union all select 'length_bin', case when k <= 10 then '0-10' when k <= 25 then '11-25' when k <= 50 then '26-50' else '51+' end, y, pred from j), c as (select \"column\", value, {CELLS.format(p='pred')} from g group by 1, 2) select \"column\", value, tp + fp + fn + tn as n, tp + fp + fn + tn < 10 as suppressed, case when tp + fp + fn + tn >= 10 then round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) end as f1, case when tp + fp + fn + tn >= 10 then round(coalesce(fp / nullif(fp + tn, 0), 0), 6) end as fpr, case when tp + fp + fn + tn >= 10 then round(coalesce(fn / nullif(fn + tp, 0), 0), 6) end as fnr from c",
        "reliability_curve": f"with {EVAL}, b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mp, avg(y::double) as o from ev group by 1) select r::int as bin, coalesce(n, 0) as n, round(mp, 6) as mean_pred, round(o, 6) as observed, round(mp - o, 6) as gap from range(10) t(r) left join b on b.bin = r",
        "calibration_errors": f"with {EVAL}, b as (select least(floor(p * 10), 9) as bin, count(*) as n, abs(avg(p) - avg(y::double)) as gap from ev group by 1), q as (select y, p, least(greatest(p, 1e-12), 1 - 1e-12) as q from ev) select round(avg((p - y) * (p - y)), 6) as brier, round(avg(-case when y = 1 then ln(q) else ln(1 - q) end), 6) as log_loss, (select round(sum(n * gap) / sum(n), 6) from b) as ece from q",
        "pr_curve": f"with {CURVE} select threshold, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from curve",
        "roc_curve": f"with {CURVE} select threshold, round(coalesce(fp / nullif(nn, 0), 0), 6) as fpr, round(coalesce(tp / nullif(np, 0), 0), 6) as tpr from curve union all select null, 0, 0",
        "average_precision": f"with {CURVE}, g as (select precision, recall - coalesce(lag(recall) over (order by threshold desc), 0) as gain from curve) select round(sum(gain * precision), 6) as average_precision from g",
        "roc_auc": f"with {EVAL} select round(sum(case when a.p > b.p then 1 when a.p = b.p then 0.5 else 0 end) / count(*), 6) as roc_auc from (select p from ev where y = 1) a, (select p from ev where y = 0) b",
        "pick_threshold_floor": f"with {CURVE}, o as (select *, (precision >= 0.8)::int as ok from curve) select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, ok = 1 as floor_met from o order by ok desc, case when ok = 1 then recall else precision end desc, case when ok = 1 then precision else recall end desc, threshold desc limit 1",
        "pick_threshold_f1": f"with {CURVE} select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, true as floor_met from curve order by f1 desc, recall desc, precision desc, threshold desc limit 1",
        "base_rate_points": f"with {BASE} select threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(precision, 6) as precision from base",
        "base_rate_threshold": f"with {BASE}, l as (select min(threshold) as low from base where precision >= 0.9), b as (select threshold as best from base order by precision desc, tpr desc, threshold desc limit 1) select round(coalesce(low, best), 6) as threshold, low is not null as target_met from l, b",
        "rule_validation": f"with {EVAL}, v as (select EIN2, label from votes where source_id = 'aspen-large__v1'), c as (select count(*) as n, count(*) filter (where label is null) as n_abstain, {CELLS.format(p='label')} from ev left join v on v.EIN2 = ev.EIN2) select n, n_abstain, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round({WILSON('tp', '(tp + fn)', '-')}, 6) as sensitivity_low, round({WILSON('tp', '(tp + fn)', '+')}, 6) as sensitivity_high, round(tn / nullif(tn + fp, 0), 6) as specificity, round({WILSON('tn', '(tn + fp)', '-')}, 6) as specificity_low, round({WILSON('tn', '(tn + fp)', '+')}, 6) as specificity_high from c",
        "threshold_sweep": f"with {SAMPLE}, g as (select tier, k from (select distinct tier from sam), range(201) t(k)) select g.tier, round(k / 200, 6) as threshold, round(count(*) filter (where floor(p * 200) >= k) / count(*), 6) as share from g join sam on sam.tier = g.tier group by g.tier, k",
        "score_histogram": f"with {SAMPLE}, b as (select tier, split, least(floor(p * 30), 29)::int as bin, count(*) as n from sam group by 1, 2, 3) select tier, split, bin, n, round(n * 30 / sum(n) over (partition by tier, split), 6) as density from b",
        "pearson": f"with {VOTES}, x as (select EIN2, avg(label::double) as a, avg(confidence) as b from votes group by 1), k as (select * from x where a is not null and b is not null) select count(*) as n, round((avg(a * b) - avg(a) * avg(b)) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 6) as pearson, round(avg(abs(a - b)), 6) as mae, round(avg((a - b) * (a - b)), 6) as mse from k",
        "pearson_constant": f"with {EVAL} select count(*) as n, null::double as pearson, round(avg(abs(p - 1)), 6) as mae, round(avg((p - 1) * (p - 1)), 6) as mse from ev",
        "summary_ci": f"with {VOTES}, s as (select source_id, count(confidence) as n, avg(confidence) as mean, stddev_samp(confidence) as sd, min(confidence) as least, max(confidence) as most from votes where confidence is not null group by 1) select source_id, n, round(mean, 6) as mean, round(sd, 6) as sd, round(least, 6) as least, round(most, 6) as most, round(mean - 1.96 * sd / sqrt(n), 6) as low, round(mean + 1.96 * sd / sqrt(n), 6) as high from s",
        "seeded_priority": f"select sample_id, {pri(7, 'sample_id')} as priority from mission_sample",
        "stratified_take": f"with {SAMPLE}, {ranked('grp, tier', 'sample_id', 7, chr(103) + 'rp <> ' + repr('?'))} select sample_id, grp, tier, round(least(5, size) / size, 9) as inclusion_prob from rk where rank <= 5",
        "human_splits": f"with {SAMPLE}, {ranked('grp', 'sample_id', 17)} select sample_id, case when rank <= 2 then 'prompt_dev' when rank <= 3 then 'monitor' when (rank - 3) % 2 = 1 then 'validation' else 'test' end as new_split from rk",
        "nested_subset": f"with {SAMPLE}, {ranked('tier', 'sample_id', 29)} select sample_id, tier from rk where rank <= ceil(size * 0.25)",
        "dev_split": f"with {SAMPLE}, {ranked('tier', 'sample_id', 31)} select sample_id, rank <= greatest(1, least(round_even(size * 0.15::double, 0), size - 1)) as is_dev from rk",
        "stratified_folds": f"with {SAMPLE}, {ranked('tier', 'sample_id', 37)} select sample_id, ((rank - 1) % 5)::int as fold from rk",
        "design_weights": f"with {EVAL} select EIN2, round(w / avg(w) over (), 9) as weight from ev",
        "apply_calibration": f"with {SCORED}, l as (select EIN2, ln(least(greatest(p, 1e-12), 1 - 1e-12) / (1 - least(greatest(p, 1e-12), 1 - 1e-12))) as x from scored) select EIN2, round(1 / (1 + exp(-(0.417 * x + 0.841))), 6) as platt, round(1 / (1 + exp(-x / 1.7)), 6) as temperature, round(x, 6) as logit from l",
        "thresholded_labels": f"with {SAMPLE}, x as (select sample_id, p, {ROUTE} as s from sam) select sample_id, s as decision_source, " + ", ".join(f"case s when 'rule_strong_positive' then 1 when 'rule_short_negative' then 0 else (p >= {t})::int end as {k}" for k, t in (("pred_label", 0.5), ("pred_label_maxf1", 0.7), ("pred_label_baserate", 0.9))) + " from x",
        "rogan_gladen_by_group": f"with {SAMPLE}, x as (select tier, {rule('mission_text')} as v from sam), o as (select tier, count(*)::double as n, avg(v::double) as o from x where v is not null group by 1), a as (select *, 0.8462 + 0.95 - 1 as den, (o + 0.95 - 1) / (0.8462 + 0.95 - 1) as x from o) select tier, n, round(o, 6) as observed, round(least(1, greatest(0, x)), 6) as estimate, round((o * (1 - o) / n + x * x * 0.8462 * (1 - 0.8462) / 13 + (1 - x) * (1 - x) * 0.95 * (1 - 0.95) / 54) / (den * den), 6) as variance, true as corrected from a",
        "ppi_overall": f"with {EVAL}, {ppi(weight='w')} select {PPI_OUT} from est",
        "ppi_by_group": f"with {EVAL}, {ppi('grp')} select grp, {PPI_OUT} from est",
        "prevalence_by_group": f"with {EVAL}, {ppi('grp')}, gs as (select distinct grp from scored), k as (select grp, count(*) as k from ev group by 1) select gs.grp, coalesce(k, 0) as n_anchor, case when coalesce(k, 0) < 8 then 'not estimated' else 'ppi' end as estimator, " + ", ".join(f"case when coalesce(k, 0) >= 8 then round(least(1, greatest(0, {x})), 6) end as {n}" for n, x in (("estimate", "e"), ("ci_lower", f"e - {Z} * sqrt(v)"), ("ci_upper", f"e + {Z} * sqrt(v)"))) + ", coalesce(k, 0) < 8 as suppressed from gs left join k on k.grp = gs.grp left join est on est.grp = gs.grp",
        "composite_prevalence": f"with {SAMPLE}, x as (select tier, {rule('mission_text')} as v from sam), o as (select tier, count(*)::double as n, avg(v::double) as o from x where v is not null group by 1), s as (select *, n / sum(n) over () as s from o), c as (select sum(n) as n, sum(s * o) as e, sum(s * s * o * (1 - o) / n) as v from s) select n, round(e, 6) as estimate, round(v, 6) as variance, round(least(1, greatest(0, e - {Z} * sqrt(v))), 6) as ci_lower, round(least(1, greatest(0, e + {Z} * sqrt(v))), 6) as ci_upper from c",
        "group_descriptives": f"with {SAMPLE}, t(grp, label) as (values {', '.join(f'''('{k}', '{v}')''' for k, v in L.GROUPS.items())}), a as (select case when grp = '?' then 'Z' else grp end as grp, count(*) as n, count(p) as n_scored, avg(p) as mp, sum((p >= 0.5)::int)::bigint as na, sum((p >= 0.9)::int)::bigint as nb from sam group by 1) select t.grp, label, coalesce(n, 0) as n, coalesce(n_scored, 0) as n_scored, coalesce(na, 0) as n_a, coalesce(nb, 0) as n_b, round(mp, 6) as mean_p, round(na / nullif(n, 0), 6) as share_a, round(nb / nullif(n, 0), 6) as share_b from t left join a on a.grp = t.grp",
        "term_counts": f"with {terms_sql('tier = ' + repr('HIGH'))} select term, round(positive_count, 6) as positive_count, round(negative_count, 6) as negative_count, document_frequency from tc",
        "bigram_counts": f"with {terms_sql('tier = ' + repr('HIGH'), 2, 2)} select term, round(positive_count, 6) as positive_count, round(negative_count, 6) as negative_count, document_frequency from tc where document_frequency >= 5",
        "keyness_terms": f"with {keyness_sql('tier = ' + repr('HIGH'))} select * from ky",
        "keyness_by_probability": f"with {keyness_sql(f'case when {hit(chr(109) + 'ission_text', REL)} then 0.75 else 0.25 end')} select * from ky",
        "top_terms": f"with {keyness_sql(hit('mission_text', REL))} (select term, 'positive' as side, z_score from ky order by z_score desc, term limit 10) union all (select term, 'negative', z_score from ky order by z_score, term limit 10)",
        "top_absolute_terms": f"with {keyness_sql(hit('mission_text', REL))} select term, z_score from ky order by abs(z_score) desc, term limit 20",
        "name_populations": f"with {FRAME}, ids as (select EIN2 from frame union select {std()} from registry) select case when EIN2 in (select EIN2 from frame where trim(mission_text) <> '') then 'mission' when EIN2 in (select EIN2 from frame) then 'name_only' else 'registry_only' end as population, EIN2 in (select {std('r.EIN2')} from registry r) as in_registry, count(*) as n from ids group by 1, 2",
        "registry_flags": f"with {NAMED} select stratum, x or c as is_flagged, count(*) as n from stra group by 1, 2",
        "clean_names": f"with {NAMED} select EIN2, name_cleaned, name_with_suffix from named where name_cleaned <> ''",
        "name_variants": f"with {NAMED}, v as (select 'suffix_stripped' as input_variant, name_cleaned as text from named where name_cleaned <> '' union all select 'suffix_retaining', name_with_suffix from named where name_cleaned <> '') select input_variant, count(*) as n, sum(length(text))::bigint as n_chars from v group by 1",
        "name_token_loss": f"with named as (select *, {cased('bare')} as name_cleaned from (select *, {_GREEDY} as bare from registry)), l as (select EIN2, list_filter({lex_tokens('ORG_NAME_CURRENT', REL)}, lambda x: not list_contains({lex_tokens('name_cleaned', REL)}, x)) as lost from named where name_cleaned <> '') select EIN2, array_to_string(lost, ',') as lost from l where len(lost) > 0",
        "name_token_difference": f"with {FRAME}, m as (select EIN2, min(mission_text) as mission from frame where mission_text is not null group by 1), x as (select r.EIN2, {lex_tokens('ORG_NAME_CURRENT', STRONG)} as a, {lex_tokens('mission', STRONG)} as b from registry r join m on m.EIN2 = r.EIN2), z as (select EIN2, list_filter(a, lambda x: not list_contains(b, x)) as a, list_filter(b, lambda x: not list_contains(a, x)) as b from x) select EIN2, array_to_string(a, ',') as a_only, array_to_string(b, ',') as b_only, case when len(a) > 0 and len(b) > 0 then 'both_names_add_token' when len(b) > 0 then 'second_name_adds_token' else 'first_name_adds_token' end as direction from z where len(a) > 0 or len(b) > 0",
        "name_conflicts": f"with {NAMED}, u as (" + " union all ".join(
            f"select '{k}' as cue from named where name_cleaned <> '' and {c}" for k, c in (
                ("saint_name", f"not x and not c and regexp_matches(coalesce(ORG_NAME_CURRENT, ''), '(^|[^{W}])(st[.]?|saint){BLANK}+[{W}]', 'i')"),
                ("faith_heritage", hit("ORG_NAME_CURRENT", ["faith", "grace", "trinity", "covenant", "heritage"])),
                ("non_christian_tradition", hit("ORG_NAME_CURRENT", ["buddha", "buddhist", "buddh", "gurdwara", "hindu", "islamic", "islam", "jain", "masjid", "mosque", "muslim", "sikh", "synagogue", "temple"])),
                ("non_english_name", hit("ORG_NAME_CURRENT", ["amigos", "asociacion", "associazione", "associacao", "centro", "comunidad", "cultura", "culturelle", "ecole", "escuela", "fondation", "fundacion", "gemeinde", "iglesia", "societe", "sociedad", "verein"]) + " or regexp_matches(coalesce(ORG_NAME_CURRENT, ''), '[^\\x00-\\x7f]')"),
            )) + ") select cue, count(*) as n from u group by 1",
        "topk_matched": f"with {SAMPLE}, b as (select split, count(*) filter (where tier = 'HIGH') as k from sam group by 1), q as (select sample_id, split, row_number() over (partition by split order by p desc, sample_id) as r from sam) select sample_id, (r <= k)::int as predicted from q join b on b.split = q.split",
        "base_rate_shift": f"with {SAMPLE}, a as (select split, tier, count(*) as n, avg((p >= 0.5)::int::double) as rate from sam group by 1, 2) select split, tier, n, round(rate, 6) as rate, round(rate / nullif(sum(rate * n) over (partition by tier) / sum(n) over (partition by tier), 0), 6) as ratio from a",
        "construct_offset": f"with {EVAL} select count(*) as n, round(avg((grp = 'X')::int::double) - avg(y::double), 6) as \"offset\" from ev",
        "weighted_accuracy": f"with {EVAL} select count(*) as n, round(sum(w * (y = pred)::int) / sum(w), 6) as weighted_accuracy from ev",
        "class_weights": f"with {EVAL}, n as (select y, count(*) as n from ev group by 1) select y, n, round((select sum(n) from n) / ((select count(*) from n) * n), 6) as class_weight from n",
        "soft_targets": f"with {SCORED}, t as (select 1.0::double as label, p as weight from scored union all select 0.0, 1 - p from scored) select label, count(*) as n, round(sum(weight), 6) as weight from t where weight > 0 group by 1",
        "label_issues": f"with {EVAL}, t as (select avg(p) filter (where y = 1) as t1, avg(1 - p) filter (where y = 0) as t0 from ev) select EIN2 from ev, t where (y = 0 and p >= t1 and p > 0.5) or (y = 1 and 1 - p >= t0 and p < 0.5)",
        "pruned_arm": f"with {EVAL}, t as (select avg(p) filter (where y = 1) as t1, avg(1 - p) filter (where y = 0) as t0 from ev) select y, count(*) as n from ev, t where not (((y = 0 and p >= t1 and p > 0.5) or (y = 1 and 1 - p >= t0 and p < 0.5)) and p > 0.34 and p < 0.66) group by 1",
        "training_frame": f"with {VOTES}, {MAJ}, {SAMPLE}, {TEXTS}, t as (select EIN2, min(t) as t from texts where trim(t) <> '' group by 1), s as (select EIN2, round(avg(label::double), 6) as p_pos from votes where label is not null group by 1) select m.EIN2, md5(t) as text_md5, p_pos, label as hard_label from majority m join t on t.EIN2 = m.EIN2 join s on s.EIN2 = m.EIN2 where label is not null and m.EIN2 not in (select EIN2 from sam where split <> 'train' and EIN2 is not null)",
        "annotator_slate": f"with {EVAL}, c as (select source_id, {CELLS.format(p='label')} from votes v join ev on ev.EIN2 = v.EIN2 where label is not null group by 1), e as (select {EXTRA} from c), b as (select source_id, {BUNDLE} from e), w as (select source_id, f1, kappa, round({WILSON('(2 * tp)', '(2 * tp + fp + fn)', '-')}, 6) as f1_low from b), o as (select *, row_number() over (order by f1 desc nulls last, kappa desc nulls last, source_id) as place, coalesce(kappa >= 0.6 and f1_low >= 0.6, false) as ok from w) select source_id, f1, kappa, f1_low, place, case when max(ok::int) over () = 1 then ok else place = 1 end as selected from o",
        "high_confidence": f"with {SCORED} select grp, count(*) as n, round(avg(p), 6) as mean_p from scored where p <= 0.2 or p >= 0.8 group by 1",
        "low_estimate": f"with {EVAL}, {SAMPLE}, {ppi()}, r as (select {rule('mission_text')} as v from sam where tier = 'LOW'), g as (select count(*)::double as n, avg(v::double) as o from r where v is not null), x as (select n, o, (o + 0.95 - 1) / (0.8462 + 0.95 - 1) as x, 0.8462 + 0.95 - 1 as den from g), parts as (select 'classifier' as part, big as n, least(1, greatest(0, e)) as estimate, v as variance from est union all select 'rules', n, least(1, greatest(0, x)), (o * (1 - o) / n + x * x * 0.8462 * (1 - 0.8462) / 13 + (1 - x) * (1 - x) * 0.95 * (1 - 0.95) / 54) / (den * den) from x), allp as (select * from parts union all select 'composite', sum(n), sum(n * estimate) / sum(n), sum(n * n * variance) / (sum(n) * sum(n)) from parts) select part, n, round(estimate, 6) as estimate, round(variance, 6) as variance from allp",
        "prevalence_decomposition": f"with {SAMPLE}, x as (select tier, {rule('mission_text')} as v from sam), o as (select tier, count(*)::double as n, avg(v::double) as o from x where v is not null group by 1) select tier, n, round(o, 6) as estimate, round(n / sum(n) over (), 6) as share, round(n / sum(n) over () * o, 6) as contribution from o",
        "stage_gates": f"with {EVAL}, {SAMPLE} select 'train_anchor_disjoint' as gate, (select count(*) from (select EIN2 from sam where split = 'train' and EIN2 is not null intersect select EIN2 from sam where split = 'anchor')) as problems union all select 'sample_id_unique', (select count(*) from (select sample_id from sam group by 1 having count(*) > 1)) union all select 'tiers_known', (select count(*) from sam where tier not in ('HIGH', 'MEDIUM', 'LOW')) union all select 'votes_in_range', (select count(*) from votes where confidence < 0 or confidence > 1) union all select 'labels_binary', (select count(*) from ev where y not in (0, 1))",
    }
    from tallyweave.plans.more_oracle import evaluation_report, more_sql

    return shard | more_sql() | {"stage_evaluation": evaluation_report(shard)}
