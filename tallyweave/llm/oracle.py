"""SQL twins of the queries that SQL can express. The others are tested against brute force, libraries or held-out rows."""

from __future__ import annotations

_EIN = "regexp_replace(regexp_replace(trim(EIN2), '\\.0+$', ''), '[^0-9]', '', 'g')"
_NINE = f"case when length({_EIN}) between 1 and 9 then lpad({_EIN}, 9, '0') end"
_STANDARD = f"case when length({_EIN}) between 1 and 9 then 'EIN-' || substr(lpad({_EIN}, 9, '0'), 1, 2) || '-' || substr(lpad({_EIN}, 9, '0'), 3) end"


def _hash(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *parts])
    return f"cast('0x' || substr(sha256({text}), 1, 15) as bigint)"


def _ledger(generations: int = 8, per_mille: int = 100, seed: int = 11) -> str:
    """The deliveries unrolled: each adds the unseen keys of lowest priority up to its quota."""
    steps = [f"k as (select {_STANDARD} as EIN2, min(load_batch) as b from mission_sample group by 1), keys as (select EIN2, b, {_hash(seed, 'EIN2')} as priority from k where EIN2 is not null)"]
    held = None
    for g in range(1, generations + 1):
        before = f"(select count(*) from l{g - 1})" if held else "0"
        unseen = f"and EIN2 not in (select EIN2 from l{g - 1})" if held else ""
        new = f"select EIN2, priority, cast({g} as integer) as generation from (select *, row_number() over (order by priority, EIN2) as r from keys where b <= {g} {unseen}) where r <= ((select count(*) from keys where b <= {g}) * {per_mille} + 999) // 1000 - {before}"
        steps.append(f"l{g} as materialized ({f'select * from l{g - 1} union all ' if held else ''}{new})")
        held = g
    return f"with {', '.join(steps)} select EIN2, priority, generation from l{generations}"


_CELL = "nullif(upper(trim({})), '')"
_UNITS = f"units as (select distinct * from (select {_NINE} as ein, {_CELL.format('ntee_major_group')} as g, {_CELL.format('tier')} as t from mission_sample) where ein is not null and g is not null and t is not null)"
_NEEDS = f"{_UNITS}, have as (select g, t, count(*) as available from units group by 1, 2), needs as (select target_id, draw_id, {_CELL.format('ntee_major_group')} as g, {_CELL.format('tier')} as t, coalesce((select available from have h where h.g = {_CELL.format('x.ntee_major_group')} and h.t = {_CELL.format('x.tier')}), 0) as available, greatest(cast(min_rows as bigint), cast(round(target_share * draw_size) as bigint)) as need, target_share, min_rows, draw_size from draw_target x)"

_DRAW = f"""with {_NEEDS},
plan as (select *, least(cast(round(target_share * 1000000) as bigint) * draw_size, available * 1000000) as e from needs where available > 0),
placed as (select *, coalesce(sum(e) over (partition by draw_id order by g, t, target_id rows between unbounded preceding and 1 preceding), 0) + {_hash(23, 'draw_id')} % 1000000 as start from plan),
ranked as (select p.*, u.ein, row_number() over (partition by p.draw_id, p.g, p.t order by {_hash(23, 'p.draw_id', 'u.ein')}, u.ein) as r from placed p join units u on u.g = p.g and u.t = p.t),
crossed as (select *, (cast(r as hugeint) * e // available + start) // 1000000 > (cast(r - 1 as hugeint) * e // available + start) // 1000000 as hit from ranked),
counted as (select *, count(*) filter (where hit) over (partition by draw_id, g, t) as drawn from crossed),
spare as (select *, row_number() over (partition by draw_id, g, t order by hit, r) as s from counted),
sample as (select draw_id, ein, g, t, greatest(e / 1000000, least(min_rows, available)) / available as prob, case when hit then 'systematic' else 'floor' end as how from spare where hit or s <= least(min_rows, available) - drawn)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_sample": _ledger(),
        "p4_found": f"with {_NEEDS} select target_id from needs where available < need",
        "p4_sample": f"{_DRAW} select draw_id, ein, g as ntee_major_group, t as tier, round(prob, 9) as inclusion_prob, how from sample",
        "p4_report": f"{_DRAW}, got as (select draw_id, g, t, count(*) as drawn from sample group by all) select target_id, n.draw_id, n.g as ntee_major_group, n.t as tier, need, available, available >= need as met, coalesce(drawn, 0) as drawn, round(coalesce(drawn, 0) / sum(coalesce(drawn, 0)) over (partition by n.draw_id), 9) as drawn_share from needs n left join got on got.draw_id = n.draw_id and got.g = n.g and got.t = n.t",
    }
