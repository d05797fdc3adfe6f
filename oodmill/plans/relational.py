"""Scans, filters, joins, aggregations, windows, set operations and splits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oodmill.operators.ranked import average_rank, descending, first_per_group, nulls_last, quantile, running_totals, share_split
from oodmill.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
select rule, count(*) as removed from (select case when not coalesce(l_quantity <= 45, false) then '1_quantity' when not coalesce(l_discount <= 0.08, false) then '2_discount'
  when not coalesce(l_tax <= 0.06, false) then '3_tax' else '4_kept' end as rule from lineitem) group by rule""")
def scan_filter_staged(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of filters with the rows each removes, in one pass; NULL fails a rule."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    rule = F.when(~ok(F.col("l_quantity") <= 45), "1_quantity").when(~ok(F.col("l_discount") <= 0.08), "2_discount").when(~ok(F.col("l_tax") <= 0.06), "3_tax").otherwise("4_kept")
    return table(spark, sf, "lineitem").groupBy(rule.alias("rule")).agg(F.count("*").alias("removed"))


@query("""
select band, count(*) as n from (select case when text is null then 'none' when length(text) < 60 then 'short' when length(text) <= 1000 then 'kept' when length(text) <= 2000 then 'long' else 'dropped' end as band
  from documents) group by band""")
def length_bands(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    band = F.when(n.isNull(), "none").when(n < 60, "short").when(n <= 1000, "kept").when(n <= 2000, "long").otherwise("dropped")
    return table(spark, sf, "documents").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""
select n_name, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all""")
def left_join_meta(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_mktsegment, count(*) as n from orders left join (select distinct c_custkey, c_mktsegment from customer) on o_custkey = c_custkey group by all")
def distinct_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    """A left join to a distinct dimension cannot multiply rows."""
    dim = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").dropDuplicates()
    return table(spark, sf, "orders").join(dim, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by all")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_orderpriority, count(*) as n from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by all")
def anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(returned, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
select uniprot, row_id, pdb_id, resolution from (select *, row_number() over (partition by uniprot order by
  has_go desc nulls last, has_ec desc nulls last, case when isnan(resolution) then null else resolution end asc nulls last, mapped_length desc nulls last, row_id) as rn from annotated_chains where uniprot is not null) where rn = 1""")
def representative_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The best record of each group in a total order of mixed directions, NULLs last, without a window."""
    res = F.when(~F.isnan("resolution"), F.col("resolution"))
    df = table(spark, sf, "annotated_chains").where("uniprot is not null").select("uniprot", "row_id", "pdb_id", "resolution", "has_go", "has_ec", "mapped_length")
    order = [descending(F.col("has_go").cast("int")), descending(F.col("has_ec").cast("int")), nulls_last(res), descending(F.col("mapped_length")), F.col("row_id")]
    return first_per_group(df, ["uniprot"], order).select("uniprot", "row_id", "pdb_id", "resolution")


@query("""
select pair, l_orderkey, l_linenumber from (select *, row_number() over (partition by pair order by l_returnflag, l_quantity desc, l_orderkey, l_linenumber, l_extendedprice) as rn from
  (select least(l_partkey, l_suppkey)::varchar || '__' || greatest(l_partkey, l_suppkey)::varchar as pair, * from lineitem)) where rn = 1""")
def unordered_pair_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.concat_ws("__", F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey"))
    rows = table(spark, sf, "lineitem").select(pair.alias("pair"), "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return first_per_group(rows, ["pair"], [F.col("l_returnflag"), -F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("pair", "l_orderkey", "l_linenumber")


@query("""
with o as (select *, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders)
select o_orderkey, case when rn <= floor(n * 0.72) then 'train' when rn <= floor(n * (0.72::double + 0.08::double)) then 'val' else 'test' end as split from o""")
def time_split_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Positional 72:8:20 split over time; positions come from range partitions, not one global window."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return share_split(o, [F.col("o_orderdate"), F.col("o_orderkey")], 0.72, 0.08).select("o_orderkey", "split")


@query("""
with f as (select o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders where o_orderstatus = 'F'),
c as (select max(o_orderdate) filter (rn = floor(n * 0.7) + 1) as t, max(o_orderdate) filter (rn = floor(n * 0.8) + 1) as v from f)
select o_orderstatus, case when o_orderdate <= t then 'train' when o_orderdate <= v then 'val' else 'test' end as split, count(*) as n from orders, c group by all""")
def time_split_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoff dates learned on one class (row floor(n * share) + 1) and applied to all."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    learn = o.where("o_orderstatus = 'F'")
    n = learn.count()
    run = running_totals(learn, [F.col("o_orderdate"), F.col("o_orderkey")], [])
    t, v = run.agg(F.max(F.when(F.col("position") == int(n * 0.7) + 1, F.col("o_orderdate"))), F.max(F.when(F.col("position") == int(n * 0.8) + 1, F.col("o_orderdate")))).first()
    split = F.when(F.col("o_orderdate") <= F.lit(t), "train").when(F.col("o_orderdate") <= F.lit(v), "val").otherwise("test")
    return o.groupBy("o_orderstatus", split.alias("split")).agg(F.count("*").alias("n"))


@query("""
with o as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, case when rn <= floor(n * 0.7) then 'train' when rn <= floor(n * (0.7::double + 0.1::double)) then 'val' else 'test' end as split from o""")
def cluster_time_split(spark: SparkSession, sf: str) -> DataFrame:
    """Positional split inside each cluster in time order; the positions survive clusters of any size."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    run = running_totals(o, [F.col("o_orderdate"), F.col("o_orderkey")], [], ["o_custkey"])
    sized = run.join(o.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")
    split = F.when(F.col("position") <= F.floor(F.col("n") * 0.7), "train").when(F.col("position") <= F.floor(F.col("n") * (0.7 + 0.1)), "val").otherwise("test")
    return sized.select("o_orderkey", split.alias("split"))


@query("""
with c as (select c_custkey, c_nationkey, c_mktsegment, row_number() over (partition by c_nationkey, c_mktsegment order by md5('42:' || c_custkey::varchar), c_custkey) as rn,
  count(*) over (partition by c_nationkey, c_mktsegment) as n from customer)
select c_custkey, case when n = 1 then 'train' when rn <= greatest(1, round_even(0.2 * n, 0)) then 'test' else 'train' end as split from c""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Test share of each stratum by hash order, half-even rounding, at least one row; singletons stay in train."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    keys = ["c_nationkey", "c_mktsegment"]
    run = running_totals(c, [F.md5(F.concat(F.lit("42:"), F.col("c_custkey").cast("string"))), F.col("c_custkey")], [], keys)
    sized = run.join(c.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    test = F.col("position") <= F.greatest(F.lit(1.0), F.bround(0.2 * F.col("n"), 0))
    return sized.select("c_custkey", F.when(F.col("n") == 1, "train").when(test, "test").otherwise("train").alias("split"))


@query("""
with g as (select o_custkey, row_number() over (order by md5('7:' || o_custkey::varchar), o_custkey) as rn, count(*) over () as n from (select distinct o_custkey from orders)),
s as (select o_custkey, case when rn <= floor(n * 0.7) then 'train' when rn <= floor(n * (0.7::double + 0.1::double)) then 'val' else 'test' end as split from g)
select split, count(*) as n, count(distinct o_custkey) as groups from orders join s using (o_custkey) group by split""")
def group_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole groups to splits 7:1:2 in hash order."""
    o = table(spark, sf, "orders").select("o_custkey")
    ids = o.distinct()
    s = share_split(ids, [F.md5(F.concat(F.lit("7:"), F.col("o_custkey").cast("string"))), F.col("o_custkey")], 0.7, 0.1).select("o_custkey", "split")
    return o.join(s, "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query("""
with o as (select o_orderkey, case when o_orderdate < timestamp '1998-01-01' then 'train' when o_orderdate < timestamp '2000-01-01' then 'val' else 'test' end as split, o_orderdate from orders),
r as (select *, row_number() over (partition by split order by o_orderdate, o_orderkey) as rn, count(*) over (partition by split) as n from o)
select o_orderkey, case when split = 'test' and rn <= n // 3 then 'val' else split end as split from r""")
def rebalance_moves(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest third of test moves to val."""
    d = F.col("o_orderdate")
    split = F.when(d < F.lit("1998-01-01").cast("timestamp_ntz"), "train").when(d < F.lit("2000-01-01").cast("timestamp_ntz"), "val").otherwise("test")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", split.alias("split"))
    n = o.where("split = 'test'").count()
    run = running_totals(o, [d, F.col("o_orderkey")], [], ["split"])
    return run.select("o_orderkey", F.when((F.col("split") == "test") & (F.col("position") <= n // 3), "val").otherwise(F.col("split")).alias("split"))


@query("""
with d as (select l_returnflag, count(*) as n, avg(l_quantity) as mean, stddev_samp(l_quantity) as sd, min(l_quantity) as least, quantile_cont(l_quantity, 0.25) as q25,
  quantile_cont(l_quantity, 0.5) as q50, quantile_cont(l_quantity, 0.75) as q75, max(l_quantity) as most, avg(case when l_discount > 0.05 then 1.0 else 0.0 end) as share from lineitem group by 1)
select l_returnflag, n, round(mean, 6) as mean, round(sd, 6) as sd, least, q25, q50, q75, most, round(share, 6) as share from d""")
def describe_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, sample deviation, quartiles with linear interpolation; values are counted before they are ranked."""
    q = lambda p: F.percentile("l_quantity", F.lit(p))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev("l_quantity"), 6).alias("sd"), F.min("l_quantity").alias("least"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("l_quantity").alias("most"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("share"),
    )


_PROFILED = ["default_flag", "ood_idr", "chain_id", "idr_ratio", "ood_longtail", "seq_redundancy_30", "tm_score_0_3"]


@query(" union all ".join(f"select '{c}' as column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing, count(distinct {c}) as values from ood_flags" for c in _PROFILED))
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Missing share and distinct count of each column in one pass, then turned to rows."""
    df = table(spark, sf, "ood_flags").select(*_PROFILED)
    one = df.agg(*[F.struct(F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias("missing"), F.count_distinct(c).alias("values")).alias(c) for c in _PROFILED])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.missing").alias("missing"), F.col(f"{c}.values").alias("values")) for c in _PROFILED])).alias("r")).select("r.*")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice >= (select quantile_cont(l_extendedprice, 0.95) from lineitem)")
def quantile_top_share(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at or above the 95 % quantile of all rows."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    cutoff = quantile(df, "l_extendedprice", 0.95)
    return df.where(F.col("l_extendedprice") >= cutoff)


@query("select l_quantity as value, count(*) as n, avg(rn) as avg_rank from (select l_quantity, row_number() over (order by l_quantity) as rn from lineitem) group by 1")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return average_rank(table(spark, sf, "lineitem"), "l_quantity")


@query("""
with r as (select (rank() over (order by l_quantity)) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, (rank() over (order by l_extendedprice)) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)
select count(*) as n, round(corr(a, b), 6) as spearman from r""")
def spearman_avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson of average ranks; ranks are computed a distinct value."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice").where("l_quantity is not null and l_extendedprice is not null")
    a = average_rank(df, "l_quantity").select(F.col("value").alias("l_quantity"), F.col("avg_rank").alias("ra"))
    b = average_rank(df, "l_extendedprice").select(F.col("value").alias("l_extendedprice"), F.col("avg_rank").alias("rb"))
    return df.join(a, "l_quantity").join(b, "l_extendedprice").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query("""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as level, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)""")
def rollup_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
select 'union' as op, count(*) as n from (select l_partkey from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R')
union all select 'intersect', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R')
union all select 'except', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R')
union all select 'except_all', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' except all select l_partkey from lineitem where l_returnflag = 'R')""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    a, b = (df.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    parts = [d.agg(F.lit(name).alias("op"), F.count("*").alias("n")) for name, d in ops.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
select user_id, event_type, count(*) as n, max(value) as most, min(ts) as first_ts, arg_max(event_id, (ts, event_id)) as last_event from events group by all""")
def grouped_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.max("value").alias("most"), F.min("ts").alias("first_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")
    )


@query("""
with b as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events), s as (select *, sum(case when prev is null or ts >= prev + interval 30 minute then 1 else 0 end) over
  (partition by user_id order by ts, event_id) as sid from b)
select user_id, min(ts) as start_ts, max(ts) + interval 30 minute as end_ts, count(*) as n from s group by user_id, sid""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


@query("select time_bucket(interval 1 hour, ts) as start_ts, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


@query("""
with m as (select user_id, floor(epoch(ts) / 60)::bigint as minute from events), d as (select distinct user_id, minute from m),
f as (select *, case when minute - lag(minute) over (partition by user_id order by minute) <= 5 then 0 else 1 end as new from d),
g as (select *, sum(new) over (partition by user_id order by minute) as grp from f)
select user_id, min(minute) as start_minute, max(minute) as end_minute, count(*) as n from g group by user_id, grp""")
def range_merge_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges a gap of at most five minutes apart become one: islands by a running count of breaks."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("bigint")
    d = table(spark, sf, "events").select("user_id", minute.alias("minute")).distinct()
    w = Window.partitionBy("user_id").orderBy("minute")
    f = d.withColumn("new", F.when(F.col("minute") - F.lag("minute").over(w) <= 5, 0).otherwise(1)).withColumn("grp", F.sum("new").over(w))
    return f.groupBy("user_id", "grp").agg(F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"), F.count("*").alias("n")).drop("grp")


@query("""
with e as (select user_id, event_id, value > 50 as hot, row_number() over (partition by user_id order by ts, event_id) as rn from events),
h as (select user_id, rn - row_number() over (partition by user_id order by rn) as isle from e where hot),
r as (select user_id, count(*) as n from h group by user_id, isle)
select u.user_id, u.n as events, coalesce(sum(r.n), 0) as hot, coalesce(max(r.n), 0) as longest from (select user_id, count(*) as n from events group by 1) u left join r on r.user_id = u.user_id group by all""")
def run_length_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Total and longest run of values above a cutoff along each user's events."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") > 50).alias("hot"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = e.withColumn("rn", F.row_number().over(w))
    isles = numbered.where("hot").withColumn("isle", F.col("rn") - F.row_number().over(Window.partitionBy("user_id").orderBy("rn")))
    runs = isles.groupBy("user_id", "isle").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.sum("n").alias("hot"), F.max("n").alias("longest"))
    every = e.groupBy("user_id").agg(F.count("*").alias("events"))
    return every.join(runs, "user_id", "left").select("user_id", "events", F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("longest", F.lit(0)).alias("longest"))


@query("""
with p as (select user_id, event_id % 64 as pos, max(case when event_type = 'error' then 1 else 0 end) as v from events group by 1, 2)
select user_id, count(*) as positions, sum(v) as marked, string_agg(v::varchar, ' ' order by pos) as label from p group by user_id""")
def positional_union_label(spark: SparkSession, sf: str) -> DataFrame:
    """Union of marks over all occurrences of a position, as one label array a user."""
    pos = F.col("event_id") % 64
    p = table(spark, sf, "events").groupBy("user_id", pos.alias("pos")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("v"))
    by_pos = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"].cast("string"))
    return p.groupBy("user_id").agg(F.count("*").alias("positions"), F.sum("v").alias("marked"), F.array_join(by_pos, " ").alias("label"))


@query("""
select o_orderkey, e.event_id from orders asof join (select ts, event_id, user_id from (select *, row_number() over (partition by user_id, ts order by event_id desc) as rn from events) where rn = 1) e
  on o_custkey % 100 = e.user_id and o_orderdate + interval 26 year >= e.ts""")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of the customer's user at or before a moment: both sides in one order, the last event carried on."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("user_id"), F.expr("o_orderdate + interval 26 years").alias("ts"))
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    both = e.select("user_id", "ts", F.lit(0).alias("side"), "event_id", F.lit(None).cast("bigint").alias("o_orderkey")).unionByName(
        o.select("user_id", "ts", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("event_id"), "o_orderkey")
    )
    w = Window.partitionBy("user_id").orderBy("ts", "side", "event_id", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).where("side = 1 and event_id is not null").select("o_orderkey", "event_id")
