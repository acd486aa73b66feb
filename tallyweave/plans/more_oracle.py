"""SQL twins of the stages' queries, written independently of the operators."""

from __future__ import annotations

from tallyweave.functions import lexicon as L
from tallyweave.plans import oracle as O
from tallyweave.plans.naming import PROBES

def ppi(name: str, anchor: str, corpus: str, by: str = "", w: str = "1.0::double", m: str = "multiplicity") -> str:
    """Tables ``{name}_e`` with e, v, n_anchor, big: the prediction-powered mean of a table of labelled and one of scored rows."""
    g, on = (f"{by}, " if by else ""), (f"using ({by})" if by else "on true")
    group = f"group by {by}" if by else ""
    return f"""{name}_a as (select {g}count(*) as n_anchor, sum(w) * sum(w) / sum(w * w) as n, sum(w * y) / sum(w) as my, sum(w * p) / sum(w) as mx, sum(w * y * p) / sum(w) as yx, sum(w * p * p) / sum(w) as xx, sum(w * y * y) / sum(w) as yy from (select *, {w} as w from {anchor}) {group}),
{name}_c as (select {g}sum({m})::double as big, sum({m} * p) / sum({m}) as mp, greatest(sum({m} * p * p) / sum({m}) - (sum({m} * p) / sum({m})) * (sum({m} * p) / sum({m})), 0) as vp from {corpus} {group}),
{name}_l as (select *, yx - my * mx as cov, greatest(xx - mx * mx, 0) as vx, greatest(yy - my * my, 0) as vy from {name}_a join {name}_c {on}),
{name}_t as (select *, coalesce(least(1, greatest(0, cov / nullif((1 + n / big) * vx, 0))), 0) as lam from {name}_l),
{name}_e as (select *, lam * mp + my - lam * mx as e, lam * lam * vp / big + greatest(vy - 2 * lam * cov + lam * lam * vx, 0) / n as v from {name}_t)"""


def ends(e: str = "e", v: str = "v") -> str:
    return f"round(least(1, greatest(0, {e})), 6) as estimate, round({v}, 6) as variance, round(least(1, greatest(0, {e} - {O.Z} * sqrt({v}))), 6) as ci_lower, round(least(1, greatest(0, {e} + {O.Z} * sqrt({v}))), 6) as ci_upper"


PRED = f"""{O.SAMPLE}, pr as (select *, case when tier2 = 'LOW' then {O.rule('mission_text')} end as rule from (select sample_id, EIN2, grp, mission_text, split, p, case when tier in ('HIGH', 'MEDIUM', 'LOW') then tier else 'LOW' end as tier2, count(*) over (partition by mission_text) as multiplicity from sam)),
an as (select *, ({O.pri(9, 'sample_id')} % 1000 / 1000 < p)::int as y, ({O.pri(3, 'sample_id')} % 3 + 1) / 4 as sample_prob from pr where split <> 'train'),
hm as (select * from pr where tier2 <> 'LOW'), ah as (select * from an where tier2 <> 'LOW')"""
HELD = "held as (select distinct EIN2 from sam where split <> 'train' and EIN2 is not null)"
FRAMED = f"""{O.VOTES}, {O.MAJ}, {O.SAMPLE}, {O.TEXTS}, {HELD}, tx as (select EIN2, min(t) as t from texts where trim(t) <> '' group by 1), sh as (select EIN2, avg(label::double) as p_pos from votes where label is not null group by 1),
tf as (select m.EIN2, t, p_pos, label as y from majority m join tx on tx.EIN2 = m.EIN2 join sh on sh.EIN2 = m.EIN2 where label is not null and m.EIN2 not in (select EIN2 from held))"""
NAMES = f"""{O.SAMPLE}, {HELD}, {O.FRAME}, reg as (select {O.std()} as EIN2, ORG_NAME_CURRENT, coalesce(starts_with(upper(trim(NTEE_IRS)), 'X'), false) as x, coalesce(try_cast(trim(BMF_FOUNDATION_CODE) as double) = 10, false) as c from registry),
nf as (select *, x or c as flag, EIN2 in (select EIN2 from frame where regexp_matches(mission_text, '[^ ]')) as has, EIN2 in (select EIN2 from held) as heldout from reg where trim(ORG_NAME_CURRENT) <> '')"""
_WORDS = ", ".join(f"'{w}'" for w in sorted({w for t in L.RELIGIOUS for w in t.split()}))


def share(c: str) -> str:
    """The stand-in score: the share of a text's words in the lexicon, smoothed."""
    toks = f"regexp_extract_all(lower(coalesce({c}, '')), '[{O.W}]{{2,}}')"
    return f"((len(list_filter({toks}, lambda x: x in ({_WORDS}))) + 0.1) / (len({toks}) + 1.0))"


SCORES = f"""{NAMES}, cl as (select *, {O.cased('bare')} as name_cleaned, {O.cased('flat')} as name_with_suffix from (select *, {O._NAME} as flat, {O._BARE} as bare from nf)),
v2 as (select EIN2, has, heldout, flag, 'suffix_stripped' as input_variant, name_cleaned as text from cl where name_cleaned <> '' union all select EIN2, has, heldout, flag, 'suffix_retaining', name_with_suffix from cl where name_cleaned <> ''),
ns as (select *, {share('text')} as prob_raw, {O.rule('text')} as lex from v2)"""
PAIRS = f"""{SCORES}, {O.SCORED}, pa as (select ns.*, s.p as prob_calibrated, (s.p >= 0.5)::int as y, coalesce(lex, 0) as lexicon from ns join scored s on s.EIN2 = ns.EIN2 where has)"""
CELLS = "count(*) filter (where y = 0 and {p} = 0) as tn, count(*) filter (where y = 0 and {p} = 1) as fp, count(*) filter (where y = 1 and {p} = 0) as fn, count(*) filter (where y = 1 and {p} = 1) as tp"


def _issues(p: str) -> str:
    return f"((y = 0 and {p} >= t1 and {p} > 0.5) or (y = 1 and 1 - {p} >= t0 and {p} < 0.5))"


def more_sql() -> dict[str, str]:
    last = "substr(EIN2, length(EIN2), 1)"
    rg = "(observed + 0.95 - 1) / (0.8462 + 0.95 - 1)"
    return {
        "probability_problems": f"with {O.SCORED}, x as (select p, case when grp = 'X' then 0.5 else 1 - p end as q from scored) select count(*) as n, count(*) filter (where p is null) as n_missing, count(*) filter (where p not between 0 and 1 or q not between 0 and 1) as n_outside, count(*) filter (where abs(p + q - 1) > 1e-6) as n_not_one from x",
        "label_gate": f"with {O.SAMPLE}, {O.FRAME}, t as (select EIN2, split, case tier when 'HIGH' then 1 when 'MEDIUM' then 0 when 'LOW' then 1 end as y from sam where split <> 'train' and EIN2 is not null), g(split) as (values ('validation'), ('test'), ('no_such_split')), x as (select 'extra ids' as problem, null::varchar as split, count(*) as n from (select EIN2 from t except select EIN2 from frame) union all select 'missing ids', null, count(*) from (select EIN2 from frame where EIN2 is not null except select EIN2 from t) union all select 'split without rows', split, (not exists (select 1 from t where t.split = g.split))::int from g union all select 'labels not 0 or 1', split, (select count(*) from t where t.split = g.split and y is null) from g) select * from x where n > 0",
        "coding_changes": f"with x as (select count(*) filter (where {last} = '7') as a, count(*) filter (where {last} in ('2', '5', '6', '8', '9')) as b, count(*) filter (where {last} = '3' and ORG_NAME_CURRENT is distinct from 'changed') as c, count(*) filter (where {last} = '3') as d from registry), y as (select 'id lost' as change, a as n from x union all select 'label not 0 or 1', b + d from x union all select 'name changed', c from x) select * from y where n > 0",
        "positive_scores": f"with {O.VOTES}, x as (select source_id, case label when 1 then confidence when 0 then 1 - confidence end as s from votes) select source_id, count(s) as n, round(avg(s), 6) as mean_score from x group by 1",
        "label_agreement": f"""with {O.EVAL}, mv as (select EIN2, count(*) filter (where label = 1) as n1, count(*) filter (where label = 0) as n0 from votes where source_type = 'llm_prompt' group by 1),
j as (select ev.EIN2, ev.y, case when n1 > n0 then 1 when n0 > n1 then 0 end as l from ev join mv on mv.EIN2 = ev.EIN2),
k as (select count(*) filter (where l is null) as na, count(*) filter (where l is not null) as n, case when count(*) filter (where y = 1 and l is not null) < count(*) filter (where y = 0 and l is not null) then 1 else 0 end as c from j),
cells as (select count(*) filter (where y = c and l = c) as tp, count(*) filter (where y <> c and l = c) as fp, count(*) filter (where y = c and l <> c) as fn, count(*) filter (where y <> c and l <> c) as tn from j, k where l is not null), e as (select {O.EXTRA} from cells)
select e.n, na as n_abstain, round((tp + tn) / e.n, 6) as agreement, c as minority_class, tp, fp, fn, tn, precision, recall, f1, mcc, kappa from (select {O.BUNDLE}, n from e) e, k""",
        "frozen_labels": f"with {O.VOTES}, {O.MAJ}, {O.SAMPLE}, {HELD} select EIN2, label, round(confidence, 6) as confidence, num_votes, num_abstain, round(agreement, 6) as agreement, tie from majority where EIN2 not in (select EIN2 from held)",
        "sample_checks": f"with {O.SAMPLE}, x as (select *, {O.hit('mission_text', O.REL)} as pos, split = 'train' as silver from sam), a as (select sample_id, count(*) as k, count(distinct silver) as q from x group by 1), y as (select 'repeated ids' as \"check\", count(*) filter (where k > 1) as n from a union all select 'ids in both pools', count(*) filter (where q > 1) from a union all select 'groups in gold', count(distinct grp) filter (where not silver) from x union all select 'positive per cent', floor(100 * count(*) filter (where silver and pos) / count(*) filter (where silver))::bigint from x) select \"check\", n, case \"check\" when 'groups in gold' then n = 26 when 'positive per cent' then n between 25 and 50 else n = 0 end as ok from y",
        "arms_scored": f"with {O.EVAL}, c as (select source_id, count(*) as n, count(*) filter (where label is null) as na, count(*) filter (where label = 1 and y = 1) as tp, count(*) filter (where label = 1 and y = 0) as fp, count(*) filter (where label = 0 and y = 1) as fn from votes v join ev on ev.EIN2 = v.EIN2 group by 1) select s.source_id, n, round(na / n, 6) as abstain_rate, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1, n is not null as overlap from (select distinct source_id from votes) s left join c on c.source_id = s.source_id",
        "classifier_rows": f"with {O.SAMPLE}, x as (select {O.ROUTE} as decision_source from sam) select decision_source, count(*) as n from x where contains(decision_source, 'classifier') group by 1",
        "smoke_rows": f"with {O.SAMPLE} select sample_id, EIN2 from sam order by sample_id limit 100",
        "training_arms": f"""with {FRAMED}, cw as (select y, (select count(*) from tf) / ((select count(distinct y) from tf) * count(*)) as w from tf group by 1), t as (select avg(p_pos) filter (where y = 1) as t1, avg(1 - p_pos) filter (where y = 0) as t0 from tf),
arms as (select 'hard' as arm, y::double as label, 1.0::double as w from tf union all select 'soft', 1.0, p_pos from tf where p_pos > 0 union all select 'soft', 0.0, 1 - p_pos from tf where 1 - p_pos > 0 union all select 'class_weighted', tf.y, w from tf join cw on cw.y = tf.y union all select 'pruned', y, 1.0 from tf, t where not ({_issues('p_pos')} and p_pos > 0.34 and p_pos < 0.66))
select arm, label, count(*) as n, round(sum(w), 4) as weight from arms group by 1, 2""",
        "embedding_frame": f"with {O.SAMPLE}, {O.TEXTS}, tx as (select EIN2, min(t) as t from texts where trim(t) <> '' group by 1) select EIN2, md5(t) as text_md5 from tx where EIN2 in (select EIN2 from sam)",
        "run_matrix": "with c as (select 'curve' as phase, m as model, 'soft' as arm, f::double as fraction, 42 as seed from (values ('small'), ('large')) a(m), (values (0.25), (1.0)) b(f) union all select 'sweep', 'small', x, 1.0, s from (values ('soft'), ('hard'), ('pruned')) a(x), (values (1), (2)) b(s) union all select 'sweep', 'large', 'soft', 1.0, s from (values (1), (2)) b(s) union all select 'final', 'small', 'hard', 1.0, s from (values (1), (2), (3)) b(s)) select phase || '-' || model || '-' || arm || '-' || case fraction when 1 then '1' else cast(fraction as varchar) end || '-' || seed as run_id, * from c",
        "documentation_curve": f"with {O.VOTES}, x as (select model_id, prompt_id, avg(confidence) as v from votes where confidence is not null group by 1, 2) select model_id, round(avg(v), 6) as mean, round(min(v), 6) as least, round(max(v), 6) as most, count(*) as n from x group by 1",
        "common_columns": "select upper(trim(tier)) as tier, coalesce(nullif(trim(ntee_major_group), ''), 'UNKNOWN') as ntee_major_group, count(*) as n from mission_sample group by 1, 2",
        "anchor_groups": f"with {O.EVAL} select grp as ntee_major_group, count(*) as n, sum(y)::bigint as n_positive from ev group by 1",
        "multiplicities": "with x as (select count(*) as multiplicity from mission_frame group by LONGEST_MISSION) select multiplicity, count(*) as n from x group by 1",
        "anchor_multiplicities": f"with {PRED}, x as (select case when sample_id % 3 <> 0 then multiplicity else 1 end as multiplicity from an) select multiplicity, count(*) as n from x group by 1",
        "hm_estimate": f"with {PRED}, {ppi('u', 'ah', 'hm')}, {ppi('w', 'ah', 'hm', w='1 / sample_prob')} select 'ppi' as estimator, n_anchor, big as n_corpus, {ends()} from u_e union all select 'ppi_weighted', n_anchor, big, {ends()} from w_e",
        "multiplicity_sensitivity": f"with {PRED}, {ppi('u', 'ah', 'hm')}, {ppi('w', 'ah', 'hm', w='multiplicity::double')} select round(least(1, greatest(0, w_e.e)), 6) as estimate, round(least(1, greatest(0, w_e.e)) - least(1, greatest(0, u_e.e)), 6) as delta, 'ok' as status from u_e, w_e",
        "group_composites": _groups(rg),
        "anchor_routes": f"with {PRED}, x as (select sample_id, tier2 as tier, mission_text from an) select tier, {O.ROUTE} as decision_source, count(*) as n from x group by all",
        "monitored_scores": f"with {O.SAMPLE} select sample_id, p, tier from sam where split = 'monitor'",
        "group_order": f"with {O.SAMPLE}, t(grp, label) as (values {', '.join(f"('{k}', '{v}')" for k, v in L.GROUPS.items())}), n as (select grp, count(*) as n from sam where grp <> '?' group by 1) select n.grp, label, n, row_number() over (order by n desc, n.grp)::int as place from n join t on t.grp = n.grp",
        "text_with_fallback": f"with {O.VOTES}, {O.FRAME}, {O.SAMPLE}, f as (select EIN2, min(mission_text) as t from frame where trim(mission_text) <> '' group by 1), s as (select EIN2, min(mission_text) as t from sam where trim(mission_text) <> '' group by 1) select v.EIN2, md5(coalesce(f.t, s.t)) as text_md5 from (select distinct EIN2 from votes) v left join f on f.EIN2 = v.EIN2 left join s on s.EIN2 = v.EIN2",
        "population_language": f"with {O.SAMPLE}, x as (select {O.rule('mission_text')} as label from sam) select label, count(*) as n from x where label is not null group by 1",
        "equal_parts": f"with {O.SAMPLE}, {O.ranked('grp', 'sample_id', 43, 'grp <> ' + repr('?'))}, q as (select grp, row_number() over (order by grp) as k, count(*) over () as g from (select distinct grp from rk)) select sample_id, rk.grp, round(least(130 // g + (k <= 130 % g)::int, size) / size, 9) as inclusion_prob from rk join q on q.grp = rk.grp where rank <= 130 // g + (k <= 130 % g)::int",
        "name_frame_counts": f"with {NAMES}, x as (select count(*) as a, count(*) filter (where has) as b, count(*) filter (where not has) as c, count(*) filter (where flag) as d, count(*) filter (where flag and not has) as e, count(*) filter (where heldout) as f from nf) select unnest(['rows', 'with mission', 'name only', 'flagged', 'flagged, name only', 'contaminated']) as name, unnest([a, b, c, d, e, f]) as n from x",
        "name_scores": f"with {SCORES} select EIN2, input_variant, round(prob_raw, 6) as prob_raw, lex as lexicon_rule_label from ns",
        "name_pair_counts": f"with {PAIRS}, x as (select count(distinct EIN2) filter (where not heldout) as e, count(distinct EIN2) filter (where heldout) as c, count(distinct EIN2) as p from pa) select unnest(['n_contaminated', 'n_evaluated', 'n_paired', 'n_without_mission_score']) as name, unnest([c, e, p, 0]) as n from x",
        "name_variant_report": f"""with {PAIRS}, q as (select *, (row_number() over (partition by input_variant order by prob_raw desc, EIN2) <= sum(lexicon) over (partition by input_variant))::int as predicted from pa where not heldout),
b as (select input_variant, least(floor(prob_raw * 10), 9) as b, abs(avg(prob_raw) - avg(y::double)) as g, count(*) as k from q group by 1, 2), ec as (select input_variant, sum(g * k) / sum(k) as ece from b group by 1),
m as (select input_variant, count(*) as n, sum(lexicon)::bigint as n_positive, (avg(prob_raw * prob_calibrated) - avg(prob_raw) * avg(prob_calibrated)) / nullif(sqrt(var_pop(prob_raw) * var_pop(prob_calibrated)), 0) as pearson, avg(abs(prob_raw - prob_calibrated)) as mae, avg((prob_raw - prob_calibrated) * (prob_raw - prob_calibrated)) as mse, avg((predicted = y)::int::double) as label_agreement, count(*) filter (where predicted = 1 and y = 1) / nullif(count(*) filter (where predicted = 1), 0) as transfer_precision, count(*) filter (where lexicon = 1 and y = 1) / nullif(count(*) filter (where lexicon = 1), 0) as lexicon_precision from q group by 1)
select m.input_variant, n, n_positive, round(pearson, 6) as pearson, round(mae, 6) as mae, round(mse, 6) as mse, round(label_agreement, 6) as label_agreement, round(transfer_precision, 6) as transfer_precision, round(lexicon_precision, 6) as lexicon_precision, round(ece, 6) as ece, coalesce(transfer_precision > lexicon_precision, false) as transfer_wins from m join ec on ec.input_variant = m.input_variant""",
        "name_external_report": f"with {SCORES}, k as (select input_variant, {CELLS.format(p='(prob_raw >= 0.05)::int')} from (select *, flag::int as y from ns) group by 1), e as (select {O.EXTRA} from k) select 'panel_scoped' as population, input_variant, {O.BUNDLE}, round((tp + fn) / n, 6) as flag_rate, round((tp + fp) / n, 6) as model_rate from e",
        "name_gold_offset": _offset(),
        "second_names": f"with {NAMES}, m as (select EIN2, min(mission_text) as mission from frame where mission_text is not null group by 1), x as (select nf.EIN2, {O.cased('bare')} as nm, {O.lex_tokens('ORG_NAME_CURRENT', O.REL)} as a, {O.lex_tokens('mission', O.REL)} as b from (select *, {O._BARE} as bare from nf) nf join m on m.EIN2 = nf.EIN2), z as (select EIN2, nm, list_filter(a, lambda q: not list_contains(b, q)) as a1, list_filter(b, lambda q: not list_contains(a, q)) as b1 from x) select EIN2, array_to_string(a1, ',') as first_only, array_to_string(b1, ',') as second_only, case when len(a1) > 0 and len(b1) > 0 then 'both_names_add_token' when len(b1) > 0 then 'second_name_adds_token' else 'first_name_adds_token' end as direction, round({share('nm')}, 6) as first_prob from z where len(a1) > 0 or len(b1) > 0",
        "annotation_run": f"with {O.TEXTS}, t as (select EIN2, min(t) as t from texts where t is not null group by 1) select 'words__' || v as source_id, contains(lower(t), 'church')::int::double as label, count(*) as n, 0 as n_again from t, (values ('v1'), ('v2')) a(v) group by 1, 2",
        "shard_scores": "select sample_id, length(coalesce(mission_text, ''))::int as score from mission_sample",
        "run_manifest": " union all ".join(f"select '{t}' as name, count(*) as n_rows, sha256('{{\"seed\": 42}}') as config_hash from {t}" for t in ("label_record", "mission_frame", "mission_sample", "registry")),
        "stage_prevalence": f"with {O.EVAL}, {ppi('u', '(select EIN2, y, p from ev)', 'scored', m='1')}, {ppi('q', '(select EIN2, y, p, w as dw from ev)', 'scored', w='dw', m='1')} select 'ppi' as estimator, n_anchor, big as n_corpus, {ends()} from u_e union all select 'ppi_weighted', n_anchor, big, {ends()} from q_e",
        "gold_set": f"with {O.SAMPLE}, c as (select *, case when {O.boundary('mission_text')} <> 'none' then 'boundary' when {O.hit('mission_text', O.REL)} then 'positive' else 'negative' end as cell from sam where grp <> '?'), r as (select *, row_number() over (partition by grp, cell order by {O.pri(13, 'sample_id')}, sample_id) as rank, count(*) over (partition by grp, cell) as size, case cell when 'boundary' then 5 else 3 end as lim from c), f as (select *, rank <= lim as fp, least(lim, size) / size as rate, case when rank <= lim then '0:' else '1:' end || sample_id as k from r), o as (select *, row_number() over (partition by grp, fp order by {O.pri(14, 'k')}, k) as r2, count(*) filter (where fp) over (partition by grp) as have from f) select sample_id, grp, cell, fp as first_pass, round(rate, 6) as quota_cell_rate from o where fp or r2 <= 12 - have",
        "keyness_sensitivity": _sensitivity(),
        "name_probes": f"with x as (select *, {O._NAME} as flat, {O._BARE} as bare from (values {', '.join(f"('{a}', '{b}', '{t}', {'null' if g is None else g})" for a, b, t, g in PROBES)}) v(probe_id, category, ORG_NAME_CURRENT, pair_id)), c as (select *, {O.cased('bare')} as text_cleaned from x) select probe_id, category, pair_id::int as pair_id, ORG_NAME_CURRENT as text_raw, text_cleaned, round({share('text_cleaned')}, 6) as prob_raw, {O.rule('text_cleaned')} as lexicon_rule_label from c",
    }


def evaluation_report(core: dict[str, str]) -> str:
    """The sections of the evaluation report, one below the other, from the twins of its parts."""
    long = lambda section, sql: f"select '{section}' as section, metric, value from (select columns(*)::double from ({sql})) unpivot include nulls (value for metric in (columns(*)))"
    parts = {"metrics": core["metric_bundle"], "calibration": core["calibration_errors"], "threshold": f"select threshold, precision, recall, f1 from ({core['pick_threshold_floor']})"}
    parts["ranking"] = f"select * from ({core['average_precision']}), ({core['roc_auc']})"
    return " union all ".join(long(k, v) for k, v in parts.items())


def _sensitivity() -> str:
    one = lambda w: f"select term, z_score from (with {O.keyness_sql(w)} select term, z_score from ky)"
    top = lambda t: f"(select term from {t} order by z_score desc, term limit 10) union (select term from {t} order by z_score, term limit 10)"
    return f"with a as ({one('tier = ' + repr('HIGH'))}), b as ({one('p >= 0.5')}), t as ({top('a')} union {top('b')}) select t.term, a.z_score as tier, b.z_score as score from t left join a on a.term = t.term left join b on b.term = t.term"


def _groups(rg: str) -> str:
    keep = lambda x, n: f"case when n_anchor >= 10 then round({x}, 6) end as {n}"
    clip = lambda x: f"case when {x} is not null then least(1, greatest(0, {x})) end"
    return f"""with {PRED}, {ppi('g', 'ah', 'hm', 'grp', '1 / sample_prob')}, lo as (select grp, sum(multiplicity)::double as nr, sum(multiplicity * rule) / sum(multiplicity) as observed from pr where tier2 = 'LOW' and rule is not null group by 1),
lr as (select grp, nr, observed, {rg} as x, 0.8462 + 0.95 - 1 as den from lo), le as (select grp, least(1, greatest(0, x)) as el, (observed * (1 - observed) / nr + x * x * 0.8462 * (1 - 0.8462) / 13 + (1 - x) * (1 - x) * 0.95 * (1 - 0.95) / 54) / (den * den) as vl from lr),
sz as (select grp, sum(multiplicity)::bigint as n, coalesce(sum(multiplicity) filter (where tier2 = 'LOW'), 0)::bigint as n_low from pr group by 1), ac as (select grp, count(*) as k from an group by 1),
j as (select sz.grp, sz.n, n_low, coalesce(k, 0) as n_anchor, n_low / sz.n as s, {clip('g_e.e')} as eh, g_e.v as vh, el, vl from sz left join ac on ac.grp = sz.grp left join g_e on g_e.grp = sz.grp left join le on le.grp = sz.grp),
o as (select *, case when s = 1 then 0 else eh end * (1 - s) + case when s = 0 then 0 else el end * s as ce, case when s = 1 then 0 else vh end * (1 - s) * (1 - s) + case when s = 0 then 0 else vl end * s * s as cv from j)
select grp, n, n_low, n_anchor, n_anchor < 10 as suppressed, {keep(clip('ce'), 'estimate')}, {keep('cv', 'variance')}, {keep(clip(f'ce - {O.Z} * sqrt(cv)'), 'ci_lower')}, {keep(clip(f'ce + {O.Z} * sqrt(cv)'), 'ci_upper')} from o"""


def _offset() -> str:
    return f"with {O.EVAL}, {NAMES}, o as (select ev.y as h, nf.flag::int as f, (ev.p >= 0.5)::int as m from ev join (select *, {O._BARE} as bare from nf) nf on nf.EIN2 = ev.EIN2 where has and not heldout and bare <> '') select count(*) as n, round(avg(f::double), 6) as flag_rate, round(avg(h::double), 6) as human_rate, round(avg(m::double), 6) as mission_rate, round(avg(f::double) - avg(h::double), 6) as \"offset\" from o"
