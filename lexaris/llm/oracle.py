"""DuckDB equivalents of the pN_ queries that SQL can express.

None for p1_sample, p4, p6_neighbours, p7, p8_mix, p8_report and p9: they are tested against brute force, round
trips or held-out labels instead.
"""

from __future__ import annotations

_NAME = "nullif(regexp_replace(lower(trim(nfc_normalize({0}))), '^[0-9]+_', ''), '')"

_POOL = f"""
names as (select {_NAME.format('name')} as cat, min(cat_id) as cat_id from cat2id group by 1),
resolved as (
  select m.doc_id, coalesce(m.cat_id, n.cat_id) as cat_id, m.deg, m.seen_at
  from doc_cats m left join names n on m.cat_id is null and n.cat = {_NAME.format('m.name')}),
valid as (
  select doc_id, cat_id, deg from (
    select *, row_number() over (partition by doc_id, cat_id order by seen_at desc nulls last, deg desc nulls last) as r
    from resolved where doc_id is not null and cat_id is not null) where r = 1),
pool as (
  select doc_id, cat_id from (
    select *, row_number() over (partition by doc_id order by deg asc nulls last, cat_id) as r
    from valid where doc_id in (select doc_id from docs)) where r = 1),
wanted as (
  select n.cat_id, max(coalesce(t.target_share, 0)) as share, max(coalesce(t.min_docs, 0)) as least
  from cat_targets t join names n on n.cat = {_NAME.format('t.name')} group by 1),
size as (select floor((select val from mapper_opts where opt = 'sampleShare') * count(*)) as s from pool)
"""

_COUNTED = """
tf_rows as (
  select doc_id, nfc_normalize(trim(term)) as term, f, seen_at from tf
  where doc_id is not null and trim(term) <> ''),
counted as (
  select doc_id, term, f from (
    select *, row_number() over (partition by doc_id, term order by seen_at desc nulls last, f desc nulls last) as r
    from tf_rows) where r = 1 and f > 0 and isfinite(f))
"""

_WEIGHTS = (
    _COUNTED
    + """,
weights as (
  select term, count(*) as df, ln((1.0 + (select count(distinct doc_id) from counted)) / (1.0 + count(*))) + 1.0 as tw
  from counted group by 1),
lengths as (select doc_id, sum(f) as len from counted group by 1)
"""
)

_FREQUENCIES = (
    _COUNTED
    + """,
o as (select max(val) filter (opt = 'minFreq') as mf, max(val) filter (opt = 'minDocFreq') as md,
             max(val) filter (opt = 'maxDocShare') as ms from mapper_opts),
freq as (select term, sum(f) as gf, count(*) as df from counted group by 1),
marked as (
  select term, gf, df, case when gf < mf or df < md then 'rare'
                            when df > ms * (select count(distinct doc_id) from counted) then 'common' end as mark
  from freq, o)
"""
)


def _vectors(space: str) -> str:
    pick = (
        "(select id, x from (select *, row_number() over (partition by id order by seen_at desc nulls last, x desc) as r "
        "from xdm) where r = 1)"
        if space == "xdm"
        else "(select id, max(x) as x from xcm group by 1)"
    )
    return f"""
v_{space} as (
  select id, x from {pick}
  where len(x) = 64 and list_count(list_filter(x, lambda v: v is not null and isfinite(v))) = 64
    and list_max(list_transform(x, lambda v: abs(v))) > 0),
s_{space} as (
  select a.id as id, b.id as other, round(list_cosine_similarity(a.x, b.x), 9) as sim
  from v_{space} a join v_{space} b on a.id <> b.id),
r_{space} as (
  select '{space}' as space, least(id, other) as id_a, greatest(id, other) as id_b from (
    select *, row_number() over (partition by id order by sim desc, other) as r from s_{space})
  where r <= (select val from mapper_opts where opt = 'knn')
    and sim >= (select val from mapper_opts where opt = 'minSim'))"""


_SOURCE = "lower(trim(nfc_normalize({0})))"

ORACLE: dict[str, str] = {
    "p1_found": f"""
with {_POOL}
select w.cat_id from wanted w left join (select cat_id, count(*) as n from pool group by 1) h using (cat_id), size
where coalesce(h.n, 0) < greatest(w.share * size.s, w.least)""",
    # one factor for all categories between their bounds, found between the points where one reaches a bound
    "p1_report": f"""
with {_POOL},
c as (select w.cat_id, coalesce(h.n, 0) as n, w.share, w.least, least(coalesce(h.n, 0), greatest(w.least, 0)) as lo,
    greatest(w.share * size.s, w.least) as wanted, size.s
  from wanted w left join (select cat_id, count(*) as n from pool group by 1) h using (cat_id), size),
goal as (select greatest(least(max(s), sum(n)), sum(lo)) as goal from c),
points as (select distinct f from (select lo / share as f from c where share > 0 union all select n / share from c where share > 0 union all select 0.0)),
sums as (select f, sum(greatest(lo, least(n, f * share))) as total from points cross join c group by 1),
above as (select f as f1, total as t1 from sums, goal where total >= goal order by f limit 1),
below as (select f as f0, total as t0 from sums, goal where total < goal order by f desc limit 1),
factor as (select case when f1 is null then (select max(f) from points) when f0 is null or t1 = t0 then f1
    else f0 + (f1 - f0) * (goal - t0) / (t1 - t0) end as f from goal left join above on true left join below on true),
placed as (select c.*, greatest(lo, least(n, f * share)) as x from c, factor),
exact as (select *, x + (n - x) * coalesce(((select goal from goal) - sum(x) over ()) / nullif(sum(n - x) over (), 0), 0)
    * case when (select count(*) from above) = 0 then 1 else 0 end as e from placed),
floors as (select *, floor(e + 1e-9) as q from exact),
ordered as (select *, row_number() over (order by round(q - e, 9), cat_id) as r, (select goal from goal) - sum(q) over () as rest from floors)
select cat_id, n as n_docs, share as target_share, least as min_docs, round(wanted, 6) as wanted,
  (q + case when r <= rest then 1 else 0 end)::bigint as quota, n < wanted as exhausted from ordered""",
    "p2_found": f"""
with {_WEIGHTS}
select doc_id, term from counted join lengths using (doc_id) join weights using (term)
where f >= 4 and f >= 0.03 * len and df between 2 and 12""",
    "p2_scores": f"""
with {_WEIGHTS}
select doc_id, term, f as lf, df, round(f / len * tw, 6) as score
from counted join lengths using (doc_id) join weights using (term)""",
    "p3_found": """
with labels as (
  select doc_id, coalesce(label, file) as label from (
    select *, row_number() over (partition by doc_id order by seen_at desc nulls last, label desc nulls last) as r
    from docs) where r = 1),
valid as (
  select doc_id, cat_id, d from (
    select *, row_number() over (partition by doc_id, cat_id order by seen_at desc nulls last, d desc nulls last) as r
    from dist) where r = 1 and d >= 0 and d <= 2)
select cat_id, doc_id from (
  select cat_id, doc_id, row_number() over (
    partition by cat_id order by d, encode(label) nulls last, doc_id) as r
  from valid join labels using (doc_id))
where r <= (select val from mapper_opts where opt = 'bestDocs')""",
    "p5_frequencies": f"with {_FREQUENCIES} select term, round(gf, 6) as gf, df, mark from marked",
    "p5_found": f"with {_FREQUENCIES} select term, mark from marked where mark is not null",
    "p6_found": f"""
with {_vectors('xdm')}, {_vectors('xcm')}
select distinct * from (select * from r_xdm union all select * from r_xcm)""",
    "p8_targets": f"""
with mixing as (
  select distinct source, greatest(coalesce(weight, 0), 0) as weight, coalesce(max_repeats, 1) as max_repeats
  from source_mix where source is not null)
select source, round(weight / (select sum(weight) from mixing), 6) as target_share, max_repeats from mixing""",
    # any size in proportion to the tokens tells the same sources; here it is the length
    "p8_found": f"""
with mixing as (
  select distinct source, {_SOURCE.format('source')} as key, greatest(coalesce(weight, 0), 0) as weight,
         coalesce(max_repeats, 1) as max_repeats from source_mix where source is not null),
own as (select {_SOURCE.format('source')} as key, sum(coalesce(length(text), 0)) as own from documents group by 1)
select distinct m.source from mixing m left join own using (key)
where m.weight / (select sum(weight) from mixing) * (select sum(own) from own) > m.max_repeats * coalesce(own.own, 0)""",
}
