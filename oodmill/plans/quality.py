"""Column-level quality queries over ood_flags, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.operators import profile
from oodmill.session import table

RULES = {"default_flag": "True|False", "ood_idr": "True|False", "chain_id": "[A-Za-z0-9]{1,4}"}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return profile.quality_issues(table(spark, sf, "ood_flags"), RULES, "load_id", "feed_id", "row_id")


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "ood_flags")
    keys = {"load_id", "feed_id"}
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c not in keys]
    other = [c for c, t in df.dtypes if c not in keys and c not in numeric and c != "annotated_at"] + ["annotated_at"]
    df = df.withColumn("annotated_at", F.date_format("annotated_at", "yyyy-MM-dd HH:mm:ss"))
    return profile.column_profile(df, "load_id", "feed_id", numeric, other)


_CELLS = " union all ".join(
    f"select load_id, feed_id, row_id, '{c}' as column_name, {c} as v, regexp_full_match({c}, '{r}') as fits from ood_flags" for c, r in RULES.items()
)

_NUMERIC = ["row_id", "seq_length", "idr_ratio"]
_TEXT = ["load_date", "dataset", "unique_id", "pdb_id", "chain_id", "uniprot", "default_flag", "ood_idr", "ind", *[f"seq_redundancy_{c}" for c in (90, 70, 50, 30)],
         *[f"tm_score_0_{c}" for c in (9, 7, 5, 3)], "ood_orphan", "ood_extremeshort", "ood_extremelong", "ood_longtail"]
_PROFILE_CELLS = " union all ".join(
    [f"select feed_id, load_id, '{c}' as column_name, case when not isnan({c}::double) then {c}::double end as num, null::varchar as text from ood_flags" for c in _NUMERIC]
    + [f"select feed_id, load_id, '{c}', null, {c}::varchar from ood_flags" for c in _TEXT]
)

QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile}
ORACLES = {
    "p4_found": f"""
with cells as ({_CELLS}),
loads as (select feed_id, load_id, lag(load_id) over (partition by feed_id order by load_id) as prev from (select distinct feed_id, load_id from ood_flags)),
gone as (select feed_id, load_id, column_name, count(*) as n, count(*) filter (where v is null or v = '') as m from cells group by all),
valid as (select feed_id, load_id, column_name, v, count(*) as n from cells where v <> '' and fits group by all),
total as (select feed_id, load_id, column_name, sum(n) as n from valid group by all),
pairs as (select l.feed_id, l.load_id, l.prev, t.column_name, t.n as n2, s.n as n1 from loads l join total t on t.feed_id = l.feed_id and t.load_id = l.load_id
  join total s on s.feed_id = l.feed_id and s.load_id = l.prev and s.column_name = t.column_name),
vals as (select distinct p.*, v.v from pairs p join valid v on v.feed_id = p.feed_id and v.column_name = p.column_name and v.load_id in (p.load_id, p.prev)),
tv as (select vals.feed_id, vals.load_id, vals.column_name, any_value(n1) as n1, any_value(n2) as n2, sum(abs(coalesce(a.n, 0) * n1 - coalesce(b.n, 0) * n2)) as d from vals
  left join valid a on a.feed_id = vals.feed_id and a.load_id = vals.load_id and a.column_name = vals.column_name and a.v = vals.v
  left join valid b on b.feed_id = vals.feed_id and b.load_id = vals.prev and b.column_name = vals.column_name and b.v = vals.v group by all)
select load_id, column_name, 'pattern' as issue, row_id from cells where v <> '' and not fits
union all
select g.load_id, g.column_name, 'null_shift', 0 from loads l join gone g on g.feed_id = l.feed_id and g.load_id = l.load_id
  join gone h on h.feed_id = l.feed_id and h.load_id = l.prev and h.column_name = g.column_name where abs(g.m * h.n - h.m * g.n) * 10 > g.n * h.n
union all
select load_id, column_name, 'value_shift', 0 from tv where 2 * d > n1 * n2""",
    "p4_profile": f"""
with c as ({_PROFILE_CELLS} union all select feed_id, load_id, 'annotated_at', null, strftime(annotated_at, '%Y-%m-%d %H:%M:%S') from ood_flags),
loads as (select feed_id, load_id, lag(load_id) over (partition by feed_id order by load_id) as prev from (select distinct feed_id, load_id from ood_flags)),
own as (select feed_id, load_id, column_name, count(*) as rows, count(*) filter (num is null and text is null) as nulls, count(distinct num) + count(distinct text) as distinct_values, min(num) as min_num, max(num) as max_num,
  min(text) as min_text, max(text) as max_text, quantile_disc(num, 0.25) as q25, quantile_disc(num, 0.5) as q50, quantile_disc(num, 0.75) as q75 from c group by all),
v as (select feed_id, load_id, column_name, num, text, count(*) as n from c where num is not null or text is not null group by all),
pair as (select feed_id, load_id, column_name, num, text, n as n2, 0 as n1 from v union all select l.feed_id, l.load_id, v.column_name, v.num, v.text, 0, v.n from v join loads l on l.feed_id = v.feed_id and l.prev = v.load_id),
m as (select feed_id, load_id, column_name, num, text, sum(n1) as n1, sum(n2) as n2 from pair group by all),
f as (select *, sum(n1) over w as c1, sum(n2) over w as c2, sum(n1) over g as v1, sum(n2) over g as v2 from m window w as (partition by feed_id, load_id, column_name order by num, text), g as (partition by feed_id, load_id, column_name)),
k as (select feed_id, load_id, column_name, case when max(v1) > 0 and max(v2) > 0 then round(max(abs(c1 * v2 - c2 * v1))::double / (max(v1)::double * max(v2)::double), 6) end as ks from f group by all)
select o.feed_id as feed, o.load_id as load, o.column_name, rows, nulls, distinct_values, min_num, max_num, min_text, max_text, q25, q50, q75, ks from own o left join k using (feed_id, load_id, column_name)""",
}
