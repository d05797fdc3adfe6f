"""Projections, look-ups, grouped sets, windows, identifiers and label codes as whole-table queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oodmill.functions import arrays, identifiers, text
from oodmill.operators import ood
from oodmill.operators.ranked import descending, first_per_group, nulls_last, running_totals
from oodmill.session import merged, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- projections and filters


@query("select c_custkey as id, c_mktsegment as segment, 'customer' as source, c_acctbal < 0 as in_debt, c_name, c_nationkey from customer")
def canonical_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Renamed, derived and dropped columns: the canonical ones first, in order, unknown ones kept behind them."""
    c = table(spark, sf, "customer").withColumn("Unnamed: 0", F.lit(1))
    named = c.withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"}).withColumns({"source": F.lit("customer"), "in_debt": F.col("c_acctbal") < 0})
    named = named.drop(*[x for x in named.columns if x.startswith("Unnamed")], "c_acctbal")
    first = ["id", "segment", "source", "in_debt"]
    return named.select(*first, *[x for x in named.columns if x not in first])


@query("""
select 'ood_' as prefix, count(*) as columns, string_agg(column_name, ',' order by column_name) as names from (describe ood_flags) where column_name like 'ood\\_%' escape '\\'
union all select 'seq_redundancy_', count(*), string_agg(column_name, ',' order by column_name) from (describe ood_flags) where column_name like 'seq\\_redundancy\\_%' escape '\\'""")
def prefix_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns found by their prefix when the plan is made."""
    columns = table(spark, sf, "ood_flags").columns
    found = {p: sorted(c for c in columns if c.startswith(p)) for p in ("ood_", "seq_redundancy_")}
    return spark.createDataFrame([(p, len(c), ",".join(c)) for p, c in found.items()], "prefix string, columns bigint, names string")


_TRUE = "('1', '1.0', 'true', 't', 'yes', 'y')"


@query(f"""
select count(*) as rows, count(*) filter (lower(trim(default_flag)) in {_TRUE}) as default_true, count(*) filter (lower(trim(ood_idr)) in {_TRUE}) as idr_true, count(*) filter (coalesce(ind, false)) as ind_true,
  count(*) filter (idr_ratio > 0.5 and not isnan(idr_ratio)) as ratio_true from ood_flags""")
def boolean_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    """Flags as texts, booleans and numbers, brought to booleans; NULL and NaN are False."""
    f = table(spark, sf, "ood_flags")
    true = lambda c: F.count_if(text.as_bool(F.col(c), f.schema[c].dataType.simpleString()))
    return f.agg(F.count("*").alias("rows"), true("default_flag").alias("default_true"), true("ood_idr").alias("idr_true"), true("ind").alias("ind_true"), true("idr_ratio").alias("ratio_true"))


@query("""
select count(try_cast(default_flag as double)) as numbers, count(*) filter (uniprot is not null and trim(uniprot) <> '' and upper(trim(uniprot)) <> 'UNDEFINED') as named,
  count(*) filter (dataset in ('ec', 'go_bp', 'go_cc', 'go_mf')) as functional, count(*) filter (dataset not in ('ec', 'go_bp', 'go_cc', 'go_mf')) as others from ood_flags""")
def coerced_and_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric coercion, sentinel exclusion, enumerations and exclusion lists as conditional counts of one scan."""
    f = table(spark, sf, "ood_flags")
    name = F.trim("uniprot")
    listed = F.col("dataset").isin("ec", "go_bp", "go_cc", "go_mf")
    return f.agg(
        F.count(F.col("default_flag").try_cast("double")).alias("numbers"), F.count_if((name != "") & (F.upper(name) != "UNDEFINED")).alias("named"),
        F.count_if(listed).alias("functional"), F.count_if(~listed).alias("others"),
    )


@query("""
with n as (select l_orderkey, l_linenumber, l_partkey % 1000 as num, chr((65 + l_linenumber % 3)::int) as code, l_suppkey % 1000 as beg, l_suppkey % 1000 + l_quantity::int as fin from lineitem)
select count(*) filter (num between beg and fin) as inside, count(*) filter ((num > beg and num < fin) or (num = beg and code = 'A') or (num = fin and code = 'B')) as by_code,
  count(*) filter ((num, code) >= (beg, 'A') and (num, code) <= (fin, 'B')) as by_order from n""")
def residue_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of residue numbers in ranges: plain, with insertion codes at the ends, and in (number, code) order."""
    n = table(spark, sf, "lineitem").select((F.col("l_partkey") % 1000).alias("num"), F.char((65 + F.col("l_linenumber") % 3).cast("int")).alias("code"), (F.col("l_suppkey") % 1000).alias("beg"), (F.col("l_suppkey") % 1000 + F.col("l_quantity").cast("int")).alias("fin"))
    ends = (F.col("num"), F.col("code"), F.col("beg"), F.lit("A"), F.col("fin"), F.lit("B"))
    spans = F.array(F.struct(F.col("beg"), F.col("fin").alias("end")))
    return n.agg(F.count_if(text.in_ranges(F.col("num"), spans)).alias("inside"), F.count_if(text.in_range_by_code(*ends)).alias("by_code"), F.count_if(text.in_range_by_order(*ends)).alias("by_order"))


@query("""
with s as (select row_id, upper(regexp_replace(aa_seq, '[^A-Za-z]', '', 'g')) as a, lag(upper(regexp_replace(aa_seq, '[^A-Za-z]', '', 'g'))) over (order by row_id) as b from sample_multilabel),
m as (select case when a = b then 'exact' when length(a) = length(b) then 'same_length' when abs(length(a) - length(b)) <= 5 then 'near' when length(a) is not null and length(b) is not null then 'large' end as kind from s)
select kind, count(*) as n from m group by kind""")
def consistency_report(spark: SparkSession, sf: str) -> DataFrame:
    """How far each sequence is from that of the row before, as from that of its structure: counts of the four kinds."""
    s = table(spark, sf, "sample_multilabel").select("row_id", F.upper(F.regexp_replace("aa_seq", "[^A-Za-z]", "")).alias("a"))
    placed = running_totals(s, [F.col("row_id")], [])
    before = placed.select((F.col("position") + 1).alias("position"), F.col("a").alias("b"))
    return placed.join(merged(before), "position", "left").groupBy(text.mismatch(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


# -- joins


@query("""
select x.o_orderpriority as priority_a, y.o_orderpriority as priority_b, count(*) as n from orders x join orders y on x.o_custkey = y.o_custkey and x.o_orderkey < y.o_orderkey group by all""")
def inner_join_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(f"key_{s}"), F.col("o_orderpriority").alias(f"priority_{s}")) for s in "ab")
    return a.join(b, "o_custkey").where("key_a < key_b").groupBy("priority_a", "priority_b").agg(F.count("*").alias("n"))


_KINDS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@query(f"select case o_orderpriority {' '.join(f"when '{k}' then {v}" for k, v in _KINDS.items())} else 0 end as weight, count(*) as n from orders group by 1")
def dictionary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A small dictionary as a map literal with a default, no join."""
    weights = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return table(spark, sf, "orders").groupBy(F.coalesce(F.try_element_at(weights, F.col("o_orderpriority")), F.lit(0)).alias("weight")).agg(F.count("*").alias("n"))


@query("""
select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then s_name else c_name end as partner from lineitem left join supplier on s_suppkey = l_suppkey
  left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey""")
def role_keyed_join(spark: SparkSession, sf: str) -> DataFrame:
    """The key, and so the dimension, depends on the row's role; each dimension is joined once."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s, o, c = (table(spark, sf, t) for t in ("supplier", "orders", "customer"))
    both = rows.join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    both = both.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("s_name")).otherwise(F.col("c_name")).alias("partner"))


@query("""
with k as (select p_partkey, unnest([{'p': 0, 'k': 'B' || p_partkey}, {'p': 1, 'k': 'A'}, {'p': 2, 'k': p_brand}, {'p': 3, 'k': p_type}], recursive := true) from part),
d as (select p_brand as k, min(p_retailprice) as v from part where p_size > 25 group by 1 union all select p_type, max(p_retailprice) from part group by 1)
select p_partkey, arg_min(v, p) as value from (select p_partkey, p, v from k join d on d.k = k.k) group by p_partkey""")
def fallback_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Several candidate keys a row, the first that the dimension knows wins."""
    p = table(spark, sf, "part")
    wanted = F.array(F.concat(F.lit("B"), F.col("p_partkey")), F.lit("A"), F.col("p_brand"), F.col("p_type"))
    k = p.select("p_partkey", F.posexplode(wanted).alias("p", "k"))
    d = p.where("p_size > 25").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_retailprice").alias("v")).union(p.groupBy("p_type").agg(F.max("p_retailprice")))
    return k.join(d, "k").groupBy("p_partkey").agg(F.min_by("v", "p").alias("value"))


@query("""
with a as (select l_partkey as id, l_returnflag as code from lineitem), b as (select l_partkey as id, l_linestatus as code from lineitem)
select id, count(distinct code) as codes, string_agg(distinct code, ';' order by code) as list from (select * from a union all select * from b) group by id""")
def multi_source_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of an entity from several sources, united."""
    l = table(spark, sf, "lineitem")
    both = l.select(F.col("l_partkey").alias("id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("code"))
    codes = F.array_sort(F.collect_set("code"))
    return both.groupBy("id").agg(F.size(codes).cast("bigint").alias("codes"), F.array_join(codes, ";").alias("list"))


@query("""
with p as (select row_number() over (order by vec_id) - 1 as row_id, embedding[1]::double as score from embeddings), m as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as row_id, o_orderkey from orders)
select o_orderkey, round(score, 6) as score from m join p using (row_id)""")
def row_aligned_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and metadata saved in the same order, joined by position; the order is named on both sides."""
    p = running_totals(table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score")), [F.col("vec_id")], [])
    m = running_totals(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], [])
    return m.select("o_orderkey", "position").join(p.select("position", F.round("score", 6).alias("score")), "position").drop("position")


@query("""
with u as (select aa_seq, length(aa_seq) as n, md5(aa_seq) as h from (select distinct aa_seq from sample_multilabel where aa_seq is not null)),
f as (select aa_seq, min(struct_file) filter (struct_source = 'PDB') as pdb, min(struct_file) as any_file from sample_multilabel where aa_seq is not null group by 1)
select row_id, n, left(h, 8) as tag, coalesce(pdb, any_file) as file from sample_multilabel s left join u on u.aa_seq = s.aa_seq left join f on f.aa_seq = s.aa_seq""")
def sequence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What is computed once a distinct sequence goes back to all its rows, with a structure file, a measured one first."""
    s = table(spark, sf, "sample_multilabel").select("row_id", "aa_seq", "struct_file", "struct_source")
    known = s.where("aa_seq is not null")
    measured = F.min(F.when(F.col("struct_source") == "PDB", F.col("struct_file")))
    per = known.groupBy("aa_seq").agg(F.coalesce(measured, F.min("struct_file")).alias("file")).withColumns({"n": F.length("aa_seq"), "tag": F.left(F.md5("aa_seq"), F.lit(8))})
    return s.select("row_id", "aa_seq").join(merged(per), "aa_seq", "left").select("row_id", "n", "tag", "file")


# -- grouped sets


@query("""
select k, v, n from (select *, row_number() over (partition by k order by n desc, v nulls last) as rn from (select 'method' as k, method as v, count(*) as n from annotated_chains group by 2
  union all select 'uniprot', uniprot, count(*) from annotated_chains group by 2)) where rn <= 5""")
def value_counts_top(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts with NULL as a value, the five most common of each column."""
    c = table(spark, sf, "annotated_chains").select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("method", "uniprot")])).alias("c"))
    counts = c.groupBy("c.k", "c.v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k").orderBy(F.desc("n"), F.asc_nulls_last("v"))
    return counts.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("""
with g as (select o_custkey, list_sort(list(distinct o_orderpriority)) as s from orders group by 1)
select count(*) as groups, (select count(distinct o_orderpriority) from orders) as whole, count(*) filter (len(s) = 1) as agreeing, count(distinct array_to_string(s, ';')) as kinds from g""")
def grouped_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Set a group, union of all sets, groups whose members agree, and distinct sets."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    whole = g.select(F.explode("s").alias("v")).distinct().agg(F.count("*").alias("whole"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.size("s") == 1).alias("agreeing"), F.count_distinct(F.array_join("s", ";")).alias("kinds")).crossJoin(F.broadcast(whole)).select("groups", "whole", "agreeing", "kinds")


@query("""
select l_suppkey as id, count(*) as occurrences, count(*) filter (l_linenumber = 1) as as_first, count(*) filter (l_linenumber > 1) as as_other, array_to_string(list_slice(list_sort(list(l_orderkey)), 1, 5), ';') as sample_ids,
  count(distinct l_partkey) as parts, count(distinct case when l_returnflag = 'R' then l_partkey end) as returned_parts, bool_or(l_returnflag = 'A') as any_a, bool_or(l_returnflag = 'N') as any_n, bool_or(l_returnflag = 'R') as any_r
from lineitem group by 1""")
def measures_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, role counts, the least five ids, distinct counts under conditions, and flags OR-ed a class.

    The five least ids are kept in order while rows are combined, so no list of all ids is built."""
    l = table(spark, sf, "lineitem")
    few = l.groupBy(F.col("l_suppkey").alias("id"), "l_orderkey").agg(F.count("*").alias("k"))
    w = Window.partitionBy("id").orderBy("l_orderkey")
    first = few.withColumn("rn", F.sum("k").over(w) - F.col("k")).where("rn < 5").groupBy("id").agg(F.slice(F.flatten(F.array_sort(F.collect_list(F.array_repeat("l_orderkey", F.col("k").cast("int"))))), 1, 5).alias("ids"))
    flag = lambda v: F.bool_or(F.col("l_returnflag") == v).alias(f"any_{v.lower()}")
    wide = l.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count("*").alias("occurrences"), F.count_if(F.col("l_linenumber") == 1).alias("as_first"), F.count_if(F.col("l_linenumber") > 1).alias("as_other"),
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"), flag("A"), flag("N"), flag("R"),
    )
    return wide.join(first, "id").withColumn("sample_ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ";")).drop("ids")


@query("""
select label, array_to_string(list_sort(list_distinct(flatten(list(list_filter(list_transform(range(0, 64), lambda i: case when embedding[i + 1] > 0.2 then i end), lambda i: i is not null))))), ';') as bits,
  count(*) as n from embeddings group by label""")
def fingerprint_union(spark: SparkSession, sf: str) -> DataFrame:
    """Bitwise OR of sparse fingerprints: bits are distinct before they are listed, at most one a place."""
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: F.when(x > 0.2, 1).otherwise(0)).alias("v"))
    bits = e.select("label", F.explode_outer(arrays.on_bits(F.col("v"))).alias("bit")).groupBy("label").agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    return n.join(bits, "label").select("label", F.array_join(F.transform("bits", lambda b: b.cast("string")), ";").alias("bits"), "n")


@query("""
select l_orderkey, sum(greatest(0, l_suppkey % 50 - l_partkey % 40 + 1)) as length from lineitem group by 1""")
def segment_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Summed lengths of inclusive segments; those that end before they begin count nothing."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.greatest(F.lit(0), F.col("l_suppkey") % 50 - F.col("l_partkey") % 40 + 1)).alias("length"))


@query("select l_suppkey as id, l_returnflag as term, arg_min(l_linestatus, (l_orderkey, l_linenumber, l_partkey, l_linestatus)) as evidence from lineitem group by all")
def first_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One entry a term of a group, the first evidence wins."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("term"), F.col("l_linestatus").alias("evidence"), "l_orderkey", "l_linenumber", "l_partkey")
    return first_per_group(rows, ["id", "term"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "evidence")]).select("id", "term", "evidence")


@query("""
with t as (select lower(trim(split)) as split, unnest(list_distinct(list_filter(list_transform(string_split(upper(label), ';'), lambda t: trim(t)), lambda t: t <> ''))) as term from sample_multilabel),
c as (select split, term, count(*) as n from t group by all), r as (select *, row_number() over (partition by split order by n desc, term) as rn from c)
select split, sum(n) as total, count(*) as terms, string_agg(term, ';' order by rn) filter (rn <= 20) as top from r group by split""")
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Label totals of each split and its twenty most common labels."""
    s = table(spark, sf, "sample_multilabel").select(F.lower(F.trim("split")).alias("split"), F.explode(text.tokens(F.upper("label"))).alias("term"))
    c = s.groupBy("split", "term").agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("n"), "term")))
    top = F.array_sort(F.collect_list(F.when(F.col("rn") <= 20, F.struct("rn", "term"))))
    return r.groupBy("split").agg(F.sum("n").alias("total"), F.count("*").alias("terms"), F.array_join(F.transform(top, lambda x: x["term"]), ";").alias("top"))


# -- windows and orders


@query("""
select l_orderkey, l_linenumber, l_partkey, rank() over w as place, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as cum,
  coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as start,
  lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as before, ntile(4) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as quarter
from lineitem window w as (partition by l_orderkey order by l_quantity, l_discount)""")
def order_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Least rank over a tuple, running sums, offsets of blocks, neighbours and tiles inside the lines of an order."""
    a = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    run = a.rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("l_quantity").over(run)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.rank().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_discount")).cast("bigint").alias("place"), cum.alias("cum"),
        (cum - F.col("l_quantity")).alias("start"), F.lag("l_quantity").over(a).alias("before"), F.ntile(4).over(a).cast("bigint").alias("quarter"),
    )


@query("""
select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as position, round(sum(o_totalprice::decimal(18, 2)) over (order by o_orderdate, o_orderkey rows unbounded preceding), 2)::double as cum from orders""")
def global_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and running sums over a whole table, from range partitions."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return running_totals(o, [F.col("o_orderdate"), F.col("o_orderkey")], ["price"]).select("o_orderkey", "position", F.col("cum_price").cast("double").alias("cum"))


@query("""
with f as (select user_id, event_type, min((ts, event_id)) as k from events group by all) select user_id, event_type, row_number() over (partition by user_id order by k) - 1 as number from f""")
def first_occurrence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers 0, 1, ... in the order in which the values of a user first occur."""
    f = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("k"))
    return f.select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("k")) - 1).cast("bigint").alias("number"))


@query("""
with c as (select label, count(*) as n, length(label) as len from sample_multilabel where label is not null group by 1)
select label, n, len from c order by n desc, len desc, label limit 25""")
def ordered_top_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 labels first in the order of -count, -length, label (a top-k report: the limit is the feature)."""
    c = table(spark, sf, "sample_multilabel").where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.length("label").alias("len"))
    return c.orderBy(F.desc("n"), F.desc("len"), "label").limit(25)


@query("""
select p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) as dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) as cheapest from part where p_size between 10 and 40 group by 1""")
def arg_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Arg max and arg min among candidates, ties to the least key."""
    p = table(spark, sf, "part").where("p_size between 10 and 40")
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


# -- set operations


@query("""
with a as (select c_custkey as id, c_mktsegment as kind, true as old from customer), b as (select s_suppkey as id, s_name as note from supplier),
u as (select id, kind, old, '' as note from a union all select id, null, false, note from b)
select kind, old, note <> '' as noted, count(*) as n from u group by all""")
def union_with_fill(spark: SparkSession, sf: str) -> DataFrame:
    """UNION ALL of tables with other columns; what a side lacks is filled by type (False, empty text, NULL)."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.lit(True).alias("old"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("note"))
    u = a.unionByName(b, allowMissingColumns=True).fillna({"old": False, "note": ""})
    return u.groupBy("kind", "old", (F.col("note") != "").alias("noted")).agg(F.count("*").alias("n"))


@query("""
select (select count(*) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer))) as outside,
  (select count(*) from ((select o_orderkey, o_custkey from orders except all select o_orderkey, o_custkey from orders where o_totalprice < 0))) as differing""")
def subset_and_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside the set they should lie in, and rows by which two tables differ without some columns."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    outside = o.select("o_custkey").distinct().join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("outside"))
    cut_ = o.select("o_orderkey", "o_custkey")
    differing = cut_.exceptAll(o.where("o_totalprice < 0").select("o_orderkey", "o_custkey")).agg(F.count("*").alias("differing"))
    return outside.crossJoin(F.broadcast(differing))


@query("""
with l as (select l_partkey as id, 'lines' as src, 0 as p from lineitem union all select p_partkey, 'parts', 1 from part where p_size > 25 union all select s_suppkey, 'suppliers', 2 from supplier)
select src, count(*) as n from (select id, arg_max(src, p) as src from l group by id) group by src""")
def priority_override(spark: SparkSession, sf: str) -> DataFrame:
    """Key lists in order of priority: a later list overrides the earlier ones."""
    lists = [("lines", table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))), ("parts", table(spark, sf, "part").where("p_size > 25").select("p_partkey")), ("suppliers", table(spark, sf, "supplier").select("s_suppkey"))]
    parts = [d.select("*", F.lit(name).alias("src"), F.lit(i).alias("p")) for i, (name, d) in enumerate(lists)]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("id").agg(F.max_by("src", "p").alias("src")).groupBy("src").agg(F.count("*").alias("n"))


# -- identifiers, codes and hashes


@query("""
with t as (select row_id, list_distinct(list_filter(list_transform(string_split_regex(label, '[;,]'), lambda x: trim(x)), lambda x: x <> '')) as t from sample_multilabel)
select row_id, coalesce(len(t), 0) as n, array_to_string(list_sort(t), '|') as tokens from t""")
def label_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed distinct tokens of a label, parted by ; or ,; NULL has none."""
    t = text.tokens(F.col("label"), ";,")
    return table(spark, sf, "sample_multilabel").select("row_id", F.coalesce(F.when(t.isNotNull(), F.size(t)), F.lit(0)).alias("n"), F.array_join(F.array_sort(t), "|").alias("tokens"))


@query("""
with c as (select p_partkey, (p_size % 7 + 1)::varchar || '.' || (case p_partkey % 4 when 0 then '-.-.-' when 1 then (p_size % 5)::varchar || '.-.-' when 2 then (p_size % 5)::varchar || '.' || (p_partkey % 9)::varchar || '.-'
  else (p_size % 5)::varchar || '.' || (p_partkey % 9)::varchar || '.n' || (p_partkey % 11)::varchar end) as ec from part),
s as (select *, list_filter(string_split(ec, '.'), lambda x: x <> '-') as f from c)
select p_partkey, len(f) as level, len(f) = 4 as full_l4, array_to_string(list_slice(string_split(ec, '.'), 1, 2), '.') as cut2, array_to_string(list_slice(string_split(ec, '.'), 1, 3), '.') || '.-' as third,
  array_to_string(list_slice(list_concat(f, ['-', '-', '-', '-']), 1, 4), '.') as padded from s""")
def ec_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level, fullness, prefixes and padding of four-place codes of every depth."""
    part = lambda c: c.cast("string")
    a, b, n = part(F.col("p_size") % 5), part(F.col("p_partkey") % 9), F.concat(F.lit("n"), part(F.col("p_partkey") % 11))
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, "-.-.-").when(k == 1, F.concat_ws(".", a, F.lit("-.-"))).when(k == 2, F.concat_ws(".", a, b, F.lit("-"))).otherwise(F.concat_ws(".", a, b, n))
    c = table(spark, sf, "part").select("p_partkey", F.concat_ws(".", part(F.col("p_size") % 7 + 1), tail).alias("ec"))
    ec = F.col("ec")
    return c.select("p_partkey", text.ec_level(ec).alias("level"), (text.ec_level(ec) == 4).alias("full_l4"), text.code_prefix(ec, 2).alias("cut2"), text.ec_third_level(F.array(ec))[0].alias("third"), text.ec_padded(ec).alias("padded"))


@query("""
select row_id, nullif(regexp_extract(unique_id, '^AF-(.+?)-F1(?:-model_v6(?:-[0-9a-f]{8})?)?$', 1), '') as acc, split_part(unique_id, '_', 1) as head, regexp_replace(regexp_replace(struct_file, '^.*/', ''), '\\.(pdb|cif|ent)(\\.gz)?$', '') as stem,
  len(string_split(struct_file, '/')) as depth, regexp_replace(task, '^go_', '') as short from sample_multilabel""")
def identifier_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Accession of model names, parts of identifiers, file stems and shortened names."""
    u = F.col("unique_id")
    return table(spark, sf, "sample_multilabel").select(
        "row_id", identifiers.model_accession(u).alias("acc"), F.substring_index(u, "_", 1).alias("head"), text.stem(F.col("struct_file")).alias("stem"),
        F.size(F.split("struct_file", "/")).cast("bigint").alias("depth"), F.regexp_replace("task", "^go_", "").alias("short"),
    )


@query("""
select row_id, md5(aa_seq) as id, left(md5(aa_seq), 8) as tag, translate(left(sha256(aa_seq), 16), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') as letters from sample_multilabel where aa_seq is not null""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Content ids, short tags, and a hash written in residue letters."""
    s = F.col("aa_seq")
    return table(spark, sf, "sample_multilabel").where("aa_seq is not null").select("row_id", F.md5(s).alias("id"), F.left(F.md5(s), F.lit(8)).alias("tag"), F.translate(F.left(F.sha2(s, 256), F.lit(16)), "0123456789abcdef", "ACDEFGHIKLMNPQRS").alias("letters"))


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, (l_partkey % 50)::varchar || '-' || (l_partkey % 50 + l_linenumber)::varchar || ',' || (l_suppkey % 90)::varchar || ',x' as t from lineitem),
s as (select l_orderkey, l_partkey, l_linenumber, unnest(string_split(t, ',')) as p from r), q as (select *, split_part(p, '-', 1)::int as b, case when p like '%-%' then split_part(p, '-', 2)::int else p::int end as e from s where regexp_full_match(p, '\\d+(-\\d+)?'))
select l_orderkey, count(*) as ranges, sum(e - b + 1) as positions, max(e) as last from q group by 1""")
def range_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Texts such as 3-7,12 read to inclusive ranges; parts that are no range fall away."""
    part = lambda c: c.cast("string")
    t = F.concat_ws(",", F.concat_ws("-", part(F.col("l_partkey") % 50), part(F.col("l_partkey") % 50 + F.col("l_linenumber"))), part(F.col("l_suppkey") % 90), F.lit("x"))
    r = table(spark, sf, "lineitem").select("l_orderkey", F.explode(text.ranges(t)).alias("r"))
    return r.groupBy("l_orderkey").agg(F.count("*").alias("ranges"), F.sum(F.col("r.end") - F.col("r.beg") + 1).alias("positions"), F.max("r.end").alias("last"))


@query("""
with g as (select l_orderkey, range(l_linenumber * 3, l_linenumber * 3 + 3 + l_suppkey % 4) as pos, l_returnflag as label from lineitem), e as (select distinct l_orderkey, unnest(pos) as position, label from g)
select l_orderkey, position, string_agg(label, '' order by label) as labels from e group by all""")
def positional_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled ranges spread over their positions: the set of labels at each."""
    first = F.col("l_linenumber") * 3
    e = table(spark, sf, "lineitem").select("l_orderkey", F.explode(F.sequence(first, first + 2 + F.col("l_suppkey") % 4)).alias("position"), F.col("l_returnflag").alias("label"))
    return e.groupBy("l_orderkey", "position").agg(F.array_join(F.array_sort(F.collect_set("label")), "").alias("labels"))


# -- arrays


_BOUNDS = [-0.3, -0.1, 0.0, 0.1, 0.3]
_CENTRES = [-0.2, 0.0, 0.2]


@query(f"""
select vec_id, len(list_filter({_BOUNDS}, lambda b: embedding[1]::double > b)) as bin, len(list_filter(embedding, lambda x: x > 0)) as bits, list_sum(list_transform(list_filter(range(0, 64), lambda i: embedding[i + 1] > 0), lambda i: i)) as places,
  {', '.join(f"round(exp(-pow((embedding[1]::double - {m}) / 0.1, 2)), 6) as rbf{i}" for i, m in enumerate(_CENTRES))}, printf('%.6f', round(-log10(abs(embedding[2]::double) * 1e-6 + 1e-9), 6)) as minus_log from embeddings""")
def array_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Bins by boundaries, sparse and dense bits, radial bases and a value on a log scale written with six places."""
    x = F.col("embedding")[0].cast("double")
    bits = arrays.on_bits(F.col("embedding"))
    rbf = arrays.rbf(x, _CENTRES, 0.1)
    log = F.format_string("%.6f", F.round(-F.log10(F.abs(F.col("embedding")[1].cast("double")) * 1e-6 + 1e-9), 6))
    dense = arrays.dense_bits(bits, 64)
    return table(spark, sf, "embeddings").select(
        "vec_id", arrays.discretise(x, _BOUNDS).cast("bigint").alias("bin"), F.aggregate(dense, F.lit(0), lambda a, b: a + b).cast("bigint").alias("bits"),
        F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("places"), *[F.round(rbf[i], 6).alias(f"rbf{i}") for i in range(len(_CENTRES))], log.alias("minus_log"),
    )


@query("""
with e as (select user_id, event_id % 40 as pos, max(case event_type when 'error' then 1 when 'click' then 0 else -1 end) as v from events group by all)
select user_id, count(*) filter (v >= 0) as valid, round(count(*) filter (v = 1)::double / nullif(count(*) filter (v >= 0), 0), 6) as of_valid, round(count(*) filter (v = 1)::double / count(*), 6) as of_length,
  count(*) filter (v = 1)::double / nullif(count(*) filter (v >= 0), 0) < 0.05 as longtail from e group by user_id""")
def residue_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Share of ones among valid entries and over the whole length, read from bracketed texts in which nan is masked."""
    v = F.max(F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 0).otherwise(-1))
    e = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 40).alias("pos")).agg(v.alias("v"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: F.when(s["v"] < 0, "nan").otherwise(s["v"].cast("string")))
    labels = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(cells, " "), F.lit("]")).alias("t")).select("user_id", arrays.parse_ints(F.col("t")).alias("labels"))
    l = F.col("labels")
    return labels.select("user_id", F.size(F.filter(l, lambda x: x >= 0)).cast("bigint").alias("valid"), F.round(arrays.masked_ratio(l), 6).alias("of_valid"), F.round(arrays.length_ratio(l), 6).alias("of_length"), (arrays.masked_ratio(l) < 0.05).alias("longtail"))


@query("select vec_id, list_sum(list_slice(embedding, 3, 6)::double[]) as part, len(list_resize(embedding, 70, 0)) as padded, list_max(list_slice(embedding, 1, 64))::double as most from embeddings")
def array_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices, padding to a length, and the greatest element."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(F.slice(e, 3, 4), F.lit(0.0), lambda a, b: a + b).alias("part"), F.size(arrays.padded(F.transform("embedding", lambda x: x.cast("int")), 70)).cast("bigint").alias("padded"), F.array_max(e).alias("most"))


@query("""
with v as (select label as g, i - 1 as term, max(embedding[i]::double) as w from embeddings, (select unnest(range(1, 65)) as i) group by all)
select g, count(*) filter (w > 0.25) as kept, round(sum(w) filter (hash_keep), 6) as masked from (select *, (term * 7 + g) % 10 >= 3 as hash_keep from v) group by g""")
def sparse_maximum(spark: SparkSession, sf: str) -> DataFrame:
    """Element-wise maximum of the vectors of a group, and the sum left by a fixed dropout mask."""
    v = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.posexplode("embedding").alias("term", "w")).groupBy("g", "term").agg(F.max(F.col("w").cast("double")).alias("w"))
    return v.groupBy("g").agg(F.count_if(F.col("w") > 0.25).alias("kept"), F.round(F.sum(F.when((F.col("term") * 7 + F.col("g")) % 10 >= 3, F.col("w"))), 6).alias("masked"))


@query("""
with v as (select term, row_number() over (order by term) - 1 as idx from (select distinct trim(unnest(string_split(label, ';'))) as term from sample_multilabel) where term <> ''),
t as (select row_id, unnest(list_distinct(list_transform(string_split(label, ';'), lambda t: trim(t)))) as term from sample_multilabel)
select row_id, array_to_string(list_sort(list(idx)), ';') as codes from t join v using (term) group by row_id""")
def multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Label sets as sparse places in a sorted vocabulary."""
    t = table(spark, sf, "sample_multilabel").select("row_id", F.explode(text.tokens(F.col("label"))).alias("term"))
    v = running_totals(t.select("term").distinct(), [F.col("term")], []).select("term", (F.col("position") - 1).alias("idx"))
    return t.join(merged(v), "term").groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: i.cast("string")), ";").alias("codes"))


# -- clusters and splits


@query("""
with s as (select row_id, aa_seq, struct_file is not null as has, row_number() over (partition by aa_seq order by struct_file is not null desc, row_id) as rn from sample_multilabel where aa_seq is not null)
select row_id, has from s where rn = 1""")
def exact_sequence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One row a sequence: one with a structure first, then the first row."""
    s = table(spark, sf, "sample_multilabel").where("aa_seq is not null").select("row_id", "aa_seq", F.col("struct_file").isNotNull().alias("has"))
    return first_per_group(s, ["aa_seq"], [descending(F.col("has").cast("int")), F.col("row_id")]).select("row_id", "has")


@query("""
with m as (select uniprot, mapped_length, row_id, resolution, method from annotated_chains where uniprot is not null)
select uniprot, count(*) as size, sum(mapped_length) as total, arg_max(row_id, (coalesce(mapped_length, -1), -row_id)) as longest, count(distinct coalesce(method, '')) as methods from m group by uniprot""")
def cluster_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Size, sums and the longest member of each cluster, ties to the least row."""
    m = table(spark, sf, "annotated_chains").where("uniprot is not null")
    return m.groupBy("uniprot").agg(
        F.count("*").alias("size"), F.sum("mapped_length").alias("total"), F.max_by("row_id", F.struct(F.coalesce("mapped_length", F.lit(-1)), -F.col("row_id"))).alias("longest"),
        F.count_distinct(F.coalesce("method", F.lit(""))).alias("methods"),
    )


@query("""
select uniprot, m as method, row_id from (select uniprot, coalesce(method, '') as m, row_id, row_number() over (partition by uniprot, coalesce(method, '') order by case when isnan(resolution) then null else resolution end nulls last, row_id) as rn
  from annotated_chains where uniprot is not null) where rn = 1""")
def composite_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """One representative a (cluster, second key), so clusters never mix second keys."""
    c = table(spark, sf, "annotated_chains").where("uniprot is not null").select("uniprot", F.coalesce("method", F.lit("")).alias("method"), "row_id", F.when(~F.isnan("resolution"), F.col("resolution")).alias("res"))
    return first_per_group(c, ["uniprot", "method"], [nulls_last(F.col("res")), F.col("row_id")]).select("uniprot", "method", "row_id")


_EXTREME = "length(aa_seq) < 60 or length(aa_seq) > 1000"


@query(f"""
with s as (select row_id, coalesce({_EXTREME}, false) as x from sample_multilabel), r as (select *, row_number() over (partition by x order by md5('11:' || row_id::varchar), row_id) as rn, count(*) over (partition by x) as n from s)
select row_id, case when x then 'extreme' when rn <= floor(n * 0.72) then 'train' when rn <= floor(n * (0.72::double + 0.08::double)) then 'val' else 'test' end as split, not x as is_default from r""")
def random_split_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """72:8:20 by hashed order of the rows of usual length; extreme rows are set aside, Default False."""
    n = F.length("aa_seq")
    s = table(spark, sf, "sample_multilabel").select("row_id", F.coalesce((n < 60) | (n > 1000), F.lit(False)).alias("x"))
    total = s.where("not x").count()
    run = running_totals(s, [F.md5(F.concat(F.lit("11:"), F.col("row_id").cast("string"))), F.col("row_id")], [], ["x"])
    split = F.when(F.col("x"), "extreme").when(F.col("position") <= int(total * 0.72), "train").when(F.col("position") <= int(total * (0.72 + 0.08)), "val").otherwise("test")
    return run.select("row_id", split.alias("split"), (~F.col("x")).alias("is_default"))


@query("""
with g as (select p, row_number() over (order by md5('5:' || p), p) as rn, count(*) over () as n from (select distinct pdb_id as p from sample_multilabel where pdb_id is not null))
select row_id, case when p is null then 'test' when rn <= floor(n * 0.8) then 'train' when rn <= floor(n * (0.8::double + 0.1::double)) then 'val' else 'test' end as split from sample_multilabel left join g on p = pdb_id""")
def entity_split(spark: SparkSession, sf: str) -> DataFrame:
    """8:1:1 by entry in hashed order; rows without one go to test."""
    s = table(spark, sf, "sample_multilabel").select("row_id", F.col("pdb_id").alias("p"))
    g = s.where("p is not null").select("p").distinct()
    n = g.count()
    run = running_totals(g, [F.md5(F.concat(F.lit("5:"), F.col("p"))), F.col("p")], []).select("p", "position")
    at = F.col("position")
    split = F.when(at.isNull(), "test").when(at <= int(n * 0.8), "train").when(at <= int(n * (0.8 + 0.1)), "val").otherwise("test")
    return s.join(merged(run), "p", "left").select("row_id", split.alias("split"))


@query("""
with e as (select uniprot as u, min(deposition_date) as d from annotated_chains where uniprot is not null group by 1),
r as (select u, d, row_number() over (order by d, u) as rn, count(*) over () as n from e where d is not null)
select e.u as uniprot, case when r.rn is null then 'test' when rn <= floor(n * 0.8) then 'train' when rn <= floor(n * 0.8) + round_even(n * 0.1, 0) then 'val' else 'test' end as split from e left join r on r.u = e.u""")
def entity_time_split(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by the day they were first seen, val rounded half to even; a missing day means test."""
    e = table(spark, sf, "annotated_chains").where("uniprot is not null").groupBy("uniprot").agg(F.min("deposition_date").alias("d"))
    n = e.where("d is not null").count()
    run = running_totals(e.where("d is not null"), [F.col("d"), F.col("uniprot")], []).select("uniprot", "position")
    cut_train, cut_val = int(n * 0.8), int(n * 0.8) + round(n * 0.1)
    at = F.col("position")
    return e.join(merged(run), "uniprot", "left").select("uniprot", F.when(at.isNull(), "test").when(at <= cut_train, "train").when(at <= cut_val, "val").otherwise("test").alias("split"))


@query("""
with s as (select row_id, lower(trim(split)) as split, struct_source, length(aa_seq) as n, label, unique_id from sample_multilabel),
m as (select *, case when struct_source = 'PDB' then 'test' when n < 60 or n > 1000 then 'test' else split end as new from s)
select split, new, count(*) as rows, count(*) filter (new = 'test' and label is not null) as eligible from m group by all""")
def source_split_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Split by source, extreme lengths moved to test, and the test rows eligible because they have a label."""
    n = F.length("aa_seq")
    s = table(spark, sf, "sample_multilabel").select(F.lower(F.trim("split")).alias("split"), "struct_source", n.alias("n"), "label")
    new = F.when(F.col("struct_source") == "PDB", "test").when((F.col("n") < 60) | (F.col("n") > 1000), "test").otherwise(F.col("split"))
    return s.withColumn("new", new).groupBy("split", "new").agg(F.count("*").alias("rows"), F.count_if((F.col("new") == "test") & F.col("label").isNotNull()).alias("eligible"))


@query("""
with t as (select distinct unique_id, regexp_replace(upper(label), ' ', '', 'g') as label from sample_multilabel where lower(trim(split)) = 'val' and label is not null and unique_id is not null),
x as (select distinct unique_id from sample_multilabel where lower(trim(split)) = 'test' and unique_id is not null)
select unique_id, min(label) as label, false as is_default from t where unique_id not in (select unique_id from x) group by unique_id""")
def recovered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to append to test: labels cleaned, one a sample, those test already has left out."""
    s = table(spark, sf, "sample_multilabel").where("unique_id is not null").select("unique_id", F.lower(F.trim("split")).alias("split"), F.regexp_replace(F.upper("label"), " ", "").alias("label"))
    have = s.where("split = 'test'").select("unique_id")
    new = s.where("split = 'val' and label is not null").join(merged(have), "unique_id", "left_anti")
    return new.groupBy("unique_id").agg(F.min("label").alias("label")).withColumn("is_default", F.lit(False))


@query("""
with c as (select c_custkey, c_nationkey * 5 + ascii(c_mktsegment) % 5 as y, row_number() over (partition by c_nationkey * 5 + ascii(c_mktsegment) % 5 order by md5('3:' || c_custkey::varchar), c_custkey) as rn,
  count(*) over (partition by c_nationkey * 5 + ascii(c_mktsegment) % 5) as n from customer where c_nationkey <> 7)
select c_custkey, case when rn <= greatest(1, round_even(0.1 * n, 0)) then 'test' when rn <= greatest(1, round_even(0.1 * n, 0)) + greatest(1, round_even(0.1 * n, 0)) and n > 2 then 'val' else 'train' end as split from c where n > 1
union all select c_custkey, 'holdout' from customer where c_nationkey = 7""")
def covering_split(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified split in which every class has a test row: a class is held out first, singletons are dropped."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_nationkey") * 5 + F.ascii("c_mktsegment") % 5).alias("y"))
    rest = c.where("c_nationkey <> 7")
    run = running_totals(rest, [F.md5(F.concat(F.lit("3:"), F.col("c_custkey").cast("string"))), F.col("c_custkey")], [], ["y"])
    sized = run.join(merged(rest.groupBy("y").agg(F.count("*").alias("n"))), "y").where("n > 1")
    k = F.greatest(F.lit(1.0), F.bround(0.1 * F.col("n"), 0))
    split = F.when(F.col("position") <= k, "test").when((F.col("position") <= 2 * k) & (F.col("n") > 2), "val").otherwise("train")
    return sized.select("c_custkey", split.alias("split")).union(c.where("c_nationkey = 7").select("c_custkey", F.lit("holdout")))


@query("""
select task, count(*) filter (lower(trim(split)) = 'train') as train, count(*) filter (lower(trim(split)) = 'test') as test, greatest(count(*) filter (lower(trim(split)) = 'train') - 4 * count(*) filter (lower(trim(split)) = 'test'), 0) as short
from sample_multilabel where struct_file is not null group by task""")
def balance_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    """How many test rows with a structure are wanting for a fourth of train, never below 0."""
    split = F.lower(F.trim("split"))
    train, test = F.count_if(split == "train"), F.count_if(split == "test")
    return table(spark, sf, "sample_multilabel").where("struct_file is not null").groupBy("task").agg(train.alias("train"), test.alias("test"), F.greatest(train - 4 * test, F.lit(0)).alias("short"))


@query("""
with f as (select p_type as code, count(*) as freq from part where p_partkey % 10 < 7 group by 1)
select p_partkey, coalesce(freq, 0) > 0 and coalesce(freq, 0) < 10 as legacy_any, p_brand like '%5' as prior from part left join f on code = p_type where p_partkey % 10 >= 7""")
def longtail_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """The older form: some code in fewer than ten reference rows, unseen ones excluded; beside a class prior."""
    p = table(spark, sf, "part").select("p_partkey", F.array("p_type").alias("codes"), "p_brand")
    flags = ood.code_flags(p.where("p_partkey % 10 >= 7"), "p_partkey", "codes", ood.code_frequency(p.where("p_partkey % 10 < 7"), "codes"), {"legacy_any": ("any", (F.col("freq") > 0) & (F.col("freq") < 10))})
    return flags.join(p.select("p_partkey", F.col("p_brand").endswith("5").alias("prior")), "p_partkey").select("p_partkey", "legacy_any", "prior")


@query("""
select task, lower(trim(split)) as split, count(*) as rows, count(*) filter (label like '%;%') as many, min(length(aa_seq)) as least, max(length(aa_seq)) as most, round(avg(length(aa_seq)), 6) as mean from sample_multilabel group by all""")
def label_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, multi-label rows and the range of a number a task and split."""
    n = F.length("aa_seq")
    return table(spark, sf, "sample_multilabel").groupBy("task", F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("rows"), F.count_if(F.col("label").contains(";")).alias("many"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


_CHECKS = {
    "row_id_unique": ("count(*) - count(distinct row_id)", lambda: F.count("*") - F.count_distinct("row_id")),
    "split_known": ("count(*) filter (lower(trim(split)) not in ('train', 'val', 'test'))", lambda: F.count_if(~F.lower(F.trim("split")).isin("train", "val", "test"))),
    "split_missing": ("count(*) filter (split is null)", lambda: F.count_if(F.col("split").isNull())),
    "sequence_letters": ("count(*) filter (regexp_matches(aa_seq, '[^A-Za-z]'))", lambda: F.count_if(F.col("aa_seq").rlike("[^A-Za-z]"))),
    "label_separator": ("count(*) filter (label like '%,%')", lambda: F.count_if(F.col("label").contains(","))),
    "file_suffix": ("count(*) filter (not regexp_matches(struct_file, '\\.(pdb|cif)$'))", lambda: F.count_if(~F.col("struct_file").rlike(r"\.(pdb|cif)$"))),
    "id_blanks": ("count(*) filter (unique_id <> trim(unique_id))", lambda: F.count_if(F.col("unique_id") != F.trim("unique_id"))),
}


@query(" union all ".join(f"select '{k}' as rule, {sql} as violations from sample_multilabel" for k, (sql, _) in _CHECKS.items()))
def format_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of schema and format with the rows that break each, all in one scan."""
    one = table(spark, sf, "sample_multilabel").agg(*[c().alias(k) for k, (_, c) in _CHECKS.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in _CHECKS])).alias("r")).select("r.*")
