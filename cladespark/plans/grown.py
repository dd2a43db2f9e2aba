"""SQL of exact decision trees, one set of common tables for each level."""

from __future__ import annotations

#: Of level ``k``: label totals, nodes, ones of features, split scores, the chosen splits (the least impurity, of equal ones the first
#: feature by name), and the samples of the next level.
LEVEL = """
 t{k} as materialized (select rep, node_id, label, sum(w) as t, dense_rank() over (order by label) as lr from a{k} group by 1, 2, 3),
 m{k} as (select rep, node_id, sum(t) as n, arg_max(label, (t, -lr)) as label, max(t) as most from t{k} group by 1, 2),
 o{k} as materialized (select rep, node_id, variant_id, label, sum(w) as o from cells join a{k} using (sample_id) group by 1, 2, 3, 4),
 v{k} as (select distinct rep, node_id, variant_id from o{k}),
 g{k} as (select rep, node_id, variant_id, t, coalesce(o, 0) as o from v{k} join t{k} using (rep, node_id) left join o{k} using (rep, node_id, variant_id, label)),
 s{k} as (select rep, node_id, variant_id, sum(t) as n, sum(o) as n1, sum(t - o) as n0, sum(t * t) as tt, sum(o * o) as oo, sum((t - o) * (t - o)) as zz from g{k} group by 1, 2, 3),
 c{k} as (select rep, node_id, variant_id, 1 - tt / (n * n) as gini, round(((n0 - zz / n0) + (n1 - oo / n1)) / n, 12) as child from s{k} where n0 > 0 and n1 > 0),
 b{k} as (select *, row_number() over (partition by rep, node_id order by child, variant_id) as place from c{k} where gini > 0),
 p{k} as materialized (select rep, node_id, variant_id, gini - child as gain, {last} + 2 * row_number() over (partition by rep order by node_id) - 1 as l from b{k} {seen} where place = 1),
 a{next} as materialized (select a.rep, a.sample_id, a.label, w, case when c.sample_id is null then l else l + 1 end as node_id from a{k} a join p{k} p using (rep, node_id) left join cells c on c.sample_id = a.sample_id and c.variant_id = p.variant_id),
 z{next} as materialized (select rep, max(l) + 1 as last_ from p{k} group by 1),"""


def relations(cells: str, labels: str) -> str:
    """Common tables ``cells`` and ``lab`` of the samples that both relations have."""
    return f"""cells as materialized (select sample_id, variant_id from {cells} where sample_id in (select sample_id from {labels})),
 lab as materialized (select sample_id, label from {labels} where sample_id in (select sample_id from {cells}))"""


def grown_sql(depth: int, samples: str = "select 0 as rep, sample_id, label, 1.0 as w from lab") -> str:
    """Common table ``nodes(rep, node_id, depth, variant_id, left_, right_, n, gain, label, most)`` of the trees of ``samples(rep, sample_id, label, w)``."""
    out = f"a0 as materialized (select rep, sample_id, label, cast(w as double) as w, cast(1 as bigint) as node_id from ({samples})),"
    for k in range(depth):
        out += LEVEL.format(k=k, next=k + 1, last="last_" if k else "1", seen=f"join z{k} using (rep)" if k else "")
    out += f" t{depth} as (select rep, node_id, label, sum(w) as t, dense_rank() over (order by label) as lr from a{depth} group by 1, 2, 3),"
    inner = [f"select rep, node_id, {k} as depth, variant_id, coalesce(l, 0) as left_, coalesce(l + 1, 0) as right_, n, coalesce(gain, 0) as gain, label, most from m{k} left join p{k} using (rep, node_id)" for k in range(depth)]
    leaf = f"select rep, node_id, {depth}, null, 0, 0, sum(t), 0, arg_max(label, (t, -lr)), max(t) from t{depth} group by 1, 2"
    return out + " nodes as materialized (" + " union all ".join([*inner, leaf]) + ")"


def bootstrap_sql(replicates: int, depth: int, seed: int) -> str:
    """Common table ``imp(rep, variant_id, importance)`` of the trees of bootstrap replicates of ``lab``, 0 for features that a tree does not use."""
    draws = f"""select rep, sample_id, label, count(*) as w from (select rep, floor(cast(('0x' || substr(md5(concat_ws('|', '{seed}', cast(rep as varchar), cast(i as varchar))), 1, 13)) as bigint) / 4503599627370496.0 * n) as i
  from nb cross join (select unnest(range(0, {replicates})) as rep)) join nb using (i) group by 1, 2, 3"""
    return f"""nb as materialized (select sample_id, label, row_number() over (order by substr(md5(sample_id), 1, 2), sample_id) - 1 as i, count(*) over () as n from lab),
 {grown_sql(depth, draws)},
 raw_ as (select rep, variant_id, sum(n * gain) as raw from nodes where variant_id is not null group by 1, 2),
 rel as (select rep, variant_id, coalesce(raw / nullif(sum(raw) over (partition by rep), 0), 0) as importance from raw_),
 imp as (select rep, variant_id, coalesce(importance, 0) as importance from (select distinct variant_id from cells) cross join (select rep from a0 group by 1 having count(distinct label) > 1) left join rel using (rep, variant_id)),
 stable as (select variant_id, avg(case when place <= greatest(1, many / 2.0) then 1.0 else 0 end) as stability from (select *, row_number() over (partition by rep order by importance desc, variant_id) as place, count(*) over (partition by rep) as many from imp) group by 1)"""
