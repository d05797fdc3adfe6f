"""Novelty flags, benchmark analytics and the flagship pipeline, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.functions.arrays import clipped_bin, right_closed_bin
from oodmill.operators import metrics, ood
from oodmill.operators.ranked import running_totals, share_split
from oodmill.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HITS = "select l_orderkey as query, l_partkey as target, 2 * l_quantity as score, l_tax as evalue from lineitem"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), (2 * F.col("l_quantity")).alias("score"), F.col("l_tax").alias("evalue"))


_LADDER = ", ".join(f"coalesce(best, 0) < {c} as seq_redundancy_{c}" for c in ood.SEQ_CUTS)


@query(f"with h as (select query, max(score) as best from ({HITS}) group by query) select o_orderkey, {_LADDER}, best is null as ood_orphan from orders left join h on query = o_orderkey")
def best_hit_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Seven ladder flags and the orphan flag from one maximum a query."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return ood.with_best_hits(o, "o_orderkey", hits(spark, sf), ood.SEQ_CUTS)


@query(f"""
with h as (select query, max(score) as best, min(evalue) as ev from ({HITS}) where query <> target group by query),
p as (select distinct l_partkey as a, l_suppkey as b from lineitem)
select a, b, coalesce(x.best, 0) < 90 or coalesce(y.best, 0) < 90 as either_90, coalesce(x.best, 0) = 0 or coalesce(y.best, 0) = 0 as either_orphan from p left join h x on x.query = a left join h y on y.query = b""")
def pair_best_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided best hits of a pair, OR over its sides, self hits excluded."""
    best = ood.best_hits(hits(spark, sf), exclude_self=True)
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    x, y = (best.select(F.col("query").alias(s), F.col("best").alias(f"best_{s}")) for s in "ab")
    score = lambda s: F.coalesce(f"best_{s}", F.lit(0.0))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.select("a", "b", ((score("a") < 90) | (score("b") < 90)).alias("either_90"), ((score("a") == 0) | (score("b") == 0)).alias("either_orphan"))


@query("select l_suppkey as complex, max((l_quantity + l_discount * 100) / 2) as best from lineitem group by 1")
def symmetric_best_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the two directed scores of a hit, best a complex."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("complex")).agg(F.max((F.col("l_quantity") + F.col("l_discount") * 100) / 2).alias("best"))


# labels of a sample: the brands of an order's parts; the split is by time
BRANDS = """b as (select l_orderkey as id, list(distinct p_brand) as codes from lineitem join part on l_partkey = p_partkey group by 1),
s as (select id, codes, o_orderdate < timestamp '1999-06-01' as ref from b join orders on id = o_orderkey)"""
# codes finer than brands: brand and type
FINE = BRANDS.replace("distinct p_brand", "distinct p_brand || '.' || p_type || '.' || p_size")


def labelled(spark: SparkSession, sf: str, fine: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reference, test): id and codes."""
    part = table(spark, sf, "part")
    code = F.concat_ws(".", "p_brand", "p_type", "p_size") if fine else F.col("p_brand")
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), code.alias("code")), "l_partkey")
    rows = pairs.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("code").alias("codes"))
    dated = cut(rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") < F.lit("1999-06-01").cast("timestamp_ntz")).alias("ref")), "id"))
    return dated.where("ref").select("id", "codes"), dated.where("not ref").select("id", "codes")


@query("select p_brand as code, count(*) as occurrences, count(distinct l_orderkey) as freq from lineitem join part on l_partkey = p_partkey group by 1")
def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("code").agg(F.count("*").alias("occurrences"), F.count_distinct("l_orderkey").alias("freq"))


@query(f"""
with {FINE}, f as (select unnest(codes) as code from s where ref), k as (select code from f group by code having count(*) between 5 and 5000),
t as (select id, unnest(codes) as code from s where not ref)
select id, count(*) as kept from t where code in (select code from k) group by id""")
def label_freq_window(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of test rows whose reference frequency lies in a window; rows left without a code fall away."""
    ref, test = labelled(spark, sf, fine=True)
    kept = ood.code_frequency(ref, "codes").where("freq between 5 and 5000").select("code")
    return test.select("id", F.explode("codes").alias("code")).join(kept, "code", "left_semi").groupBy("id").agg(F.count("*").alias("kept"))


def _code_sql(flags: str) -> str:
    return f"""
with {FINE}, f as (select code, count(*) as freq from (select unnest(codes) as code from s where ref) group by code),
t as (select id, unnest(codes) as code from s where not ref), j as (select id, coalesce(freq, 0) as freq from t left join f on f.code = t.code)
select id, {flags} from j group by id"""


@query(_code_sql("bool_or(freq between 1 and 10) as ood_longtail"))
def longtail_any(spark: SparkSession, sf: str) -> DataFrame:
    """Some code stands in 1 to 10 reference rows; codes unseen there do not count."""
    ref, test = labelled(spark, sf, fine=True)
    return ood.code_flags(test, "id", "codes", ood.code_frequency(ref, "codes"), {"ood_longtail": ("any", F.col("freq").between(1, 10))})


@query("""
with f as (select p_type || p_size as code, count(*) as freq from part where p_partkey % 10 < 7 group by 1)
select p_partkey, coalesce(freq, 0) <= 10 as ood_longtail from part left join f on code = p_type || p_size where p_partkey % 10 >= 7""")
def longtail_single(spark: SparkSession, sf: str) -> DataFrame:
    """Single-label form; the split of parts is by their key's last digit."""
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_type", "p_size").alias("code"), (F.col("p_partkey") % 10 < 7).alias("ref"))
    freq = p.where("ref").groupBy("code").agg(F.count("*").alias("freq"))
    return p.where("not ref").join(freq, "code", "left").select("p_partkey", (F.coalesce("freq", F.lit(0)) <= 10).alias("ood_longtail"))


@query(_code_sql("bool_and(freq = 0) as ood_new, bool_or(freq = 0) as ood_new_any"))
def new_code_all_not_in(spark: SparkSession, sf: str) -> DataFrame:
    ref, test = labelled(spark, sf, fine=True)
    return ood.code_flags(test, "id", "codes", ood.code_frequency(ref, "codes"), {"ood_new": ("all", F.col("freq") == 0), "ood_new_any": ("any", F.col("freq") == 0)})


@query(_code_sql("bool_and(freq < 5) as ood_longtail_le5, bool_and(freq < 10) as ood_longtail_le10, bool_and(freq <= 10) as inclusive_10"))
def longtail_code_all_not_in(spark: SparkSession, sf: str) -> DataFrame:
    """All codes rarer than the threshold in the reference, unseen included."""
    ref, test = labelled(spark, sf, fine=True)
    flags = {"ood_longtail_le5": ("all", F.col("freq") < 5), "ood_longtail_le10": ("all", F.col("freq") < 10), "inclusive_10": ("all", F.col("freq") <= 10)}
    return ood.code_flags(test, "id", "codes", ood.code_frequency(ref, "codes"), flags)


@query("""
with v as (select l_orderkey, l_linenumber, l_partkey, l_shipdate < timestamp '1999-01-01' as ref, case when l_extendedprice > 0 and l_extendedprice <= 100000 then ceil(round(l_extendedprice / 500, 9))::int - 1 end as bin from lineitem),
c as (select bin, count(*) as n from v where ref and bin is not null group by bin)
select coalesce(v.bin, -1) as bin, count(*) as rows, count(*) filter (v.bin is not null and coalesce(n, 0) <= 50) as le50, count(*) filter (v.bin is not null and coalesce(n, 0) <= 100) as le100
from v left join c on c.bin = v.bin where not ref group by 1""")
def value_bin_longtail(spark: SparkSession, sf: str) -> DataFrame:
    """Right-closed value bins, rare by their reference count; outside the bins no row is rare."""
    v = table(spark, sf, "lineitem").select(right_closed_bin(F.col("l_extendedprice"), 0.0, 100_000.0, 500.0).alias("bin"), (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("ref"))
    counts = v.where("ref and bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    rare = lambda k: F.count_if(F.col("bin").isNotNull() & (F.coalesce("n", F.lit(0)) <= k))
    tested = v.where("not ref").groupBy("bin").agg(F.count("*").alias("rows"))
    flagged = tested.join(counts, "bin", "left")
    at = lambda k: F.when(F.col("bin").isNotNull() & (F.coalesce("n", F.lit(0)) <= k), F.col("rows")).otherwise(0)
    return flagged.select(F.coalesce("bin", F.lit(-1)).alias("bin"), "rows", at(50).alias("le50"), at(100).alias("le100"))


@query("""
select case when l_discount <= 0.01 then 'clip_lo' when l_discount >= 0.09 then 'clip_hi' else 'bin_' || (ceil(round((l_discount - 0.01) / 0.02, 9))::int - 1)::varchar end as bin, count(*) as n from lineitem group by 1""")
def clip_bin_longtail(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(clipped_bin(F.col("l_discount"), 0.01, 0.09, 0.02).alias("bin")).agg(F.count("*").alias("n"))


@query("""
with c as (select c_custkey, n_regionkey::varchar || '.' || c_nationkey::varchar || '.' || c_mktsegment as code, n_regionkey::varchar || '.' || c_nationkey::varchar as top, c_acctbal < 0 as test from customer join nation on c_nationkey = n_nationkey),
r as (select distinct code from c where not test), t as (select distinct top from c where not test)
select c_custkey, code not in (select code from r) as superfamily_holdout, top not in (select top from t) as fold_holdout from c where test""")
def hierarchy_holdout_any(spark: SparkSession, sf: str) -> DataFrame:
    """Codes and code prefixes of test rows that the reference does not have."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf, "customer").join(n, "c_nationkey").select("c_custkey", F.concat_ws(".", "n_regionkey", "c_nationkey", "c_mktsegment").alias("code"), F.concat_ws(".", "n_regionkey", "c_nationkey").alias("top"), (F.col("c_acctbal") < 0).alias("test"))
    ref = c.where("not test")
    out = c.where("test")
    for col, name in (("code", "superfamily_holdout"), ("top", "fold_holdout")):
        out = out.join(ref.select(col, F.lit(False).alias(name)).distinct(), col, "left").withColumn(name, F.coalesce(name, F.lit(True)))
    return out.select("c_custkey", "superfamily_holdout", "fold_holdout")


@query(f"""
with {FINE}, e as (select id, ref, unnest(codes) as code from s),
p as (select x.id, x.ref, x.code as a, y.code as b from e x join e y on x.id = y.id and x.code < y.code),
k as (select distinct a, b from p where ref), t as (select distinct p.id from p anti join k on k.a = p.a and k.b = p.b where not p.ref)
select id, id in (select id from t) as ood_combinatorial from s where not ref""")
def combinatorial_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ref, test = labelled(spark, sf, fine=True)
    return ood.new_pairs(test, ref, "id", "codes")


FLAGS = ["seq_redundancy_90", "seq_redundancy_70", "seq_redundancy_50", "seq_redundancy_30", "tm_score_0_9", "tm_score_0_7", "tm_score_0_5", "tm_score_0_3", "ood_orphan", "ood_extremeshort", "ood_extremelong", "ood_longtail"]


@query(f"select dataset, not ({' or '.join(f'coalesce({f}, false)' for f in FLAGS)}) as derived, count(*) as n, count(*) filter (ind) as stored from ood_flags group by all")
def ind_flag(spark: SparkSession, sf: str) -> DataFrame:
    """In distribution: no flag True on any axis, NULL counting as False; beside what the table says."""
    return table(spark, sf, "ood_flags").groupBy("dataset", ood.ind(FLAGS).alias("derived")).agg(F.count("*").alias("n"), F.count_if("ind").alias("stored"))


CHAINS = [("ood_orphan", "seq_redundancy_30"), ("seq_redundancy_30", "seq_redundancy_50"), ("seq_redundancy_50", "seq_redundancy_70"), ("seq_redundancy_70", "seq_redundancy_90"), ("tm_score_0_3", "tm_score_0_5"), ("tm_score_0_5", "tm_score_0_7"), ("tm_score_0_7", "tm_score_0_9")]


@query(" union all ".join(f"select '{a}' as inner_flag, '{b}' as outer_flag, count(*) filter ({a} and not {b}) as violations from ood_flags" for a, b in CHAINS))
def nestedness_check(spark: SparkSession, sf: str) -> DataFrame:
    return ood.nested_violations(table(spark, sf, "ood_flags"), CHAINS)


@query(" union all ".join(f"select '{f}' as scenario, dataset, count(*) filter ({f}) as n, case when count({f}) = 0 then '-' else count(*) filter ({f})::varchar || '/' || count(*)::varchar end as cell from ood_flags group by dataset" for f in FLAGS))
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a flag holds in each task, all flags in one scan; `-` where the flag was never computed."""
    df = table(spark, sf, "ood_flags")
    one = df.groupBy("dataset").agg(F.count("*").alias("rows"), *[F.struct(F.count_if(f).alias("n"), F.count(f).alias("known")).alias(f) for f in FLAGS])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("scenario"), F.col(f"{f}.n").alias("n"), F.col(f"{f}.known").alias("known")) for f in FLAGS]))
    long = one.select("dataset", "rows", cells.alias("c")).select("dataset", "rows", "c.*")
    return long.select("scenario", "dataset", "n", F.when(F.col("known") == 0, "-").otherwise(F.concat_ws("/", "n", "rows")).alias("cell"))


@query(f"""
with e as ({' union all '.join(f"select row_id, dataset, '{f}' as flag from ood_flags where {f}" for f in FLAGS)}),
n as (select dataset, flag, count(*) as n from e group by all), p as (select x.dataset, x.flag as a, y.flag as b, count(*) as both_true from e x join e y on x.row_id = y.row_id and x.flag < y.flag group by all)
select x.dataset, x.flag as a, y.flag as b, coalesce(both_true, 0) as both_true, round(coalesce(both_true, 0) / (x.n + y.n - coalesce(both_true, 0)), 6) as jaccard
from n x join n y on x.dataset = y.dataset and x.flag < y.flag left join p on p.dataset = x.dataset and p.a = x.flag and p.b = y.flag""")
def axis_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard of each two flags in each task: all pair counts are sums of one pass, no row is joined with itself."""
    df = table(spark, sf, "ood_flags").select("dataset", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])
    names = sorted(FLAGS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = df.groupBy("dataset").agg(*[F.count_if(f).alias(f) for f in names], *[F.count_if(F.col(a) & F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("na"), F.col(b).alias("nb"), F.col(f"p{i}").alias("both_true")) for i, (a, b) in enumerate(pairs)]))
    long = sums.select("dataset", rows.alias("r")).select("dataset", "r.*").where("na > 0 and nb > 0")
    return long.select("dataset", "a", "b", "both_true", F.round(F.col("both_true") / (F.col("na") + F.col("nb") - F.col("both_true")), 6).alias("jaccard"))


@query(f"""
with {FINE}, f as (select code, count(*) as freq from (select unnest(codes) as code from s) group by code),
r as (select code, freq, row_number() over (order by freq desc, code) as rn, count(*) over () as n, sum(freq) over () as total from f)
select max(n) as labels, round(sum(freq) filter (rn <= ceil(0.2 * n)) / max(total), 6) as head20, round(sum(freq) filter (rn > n - floor(0.5 * n)) / max(total), 6) as tail50,
  round(avg(case when freq = 1 then 1.0 else 0.0 end), 6) as singleton, round(regr_slope(ln(freq), ln(rn)), 6) as zipf from r""")
def zipf_longtail_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the most and least frequent labels, singletons, and the slope of log frequency on log rank."""
    ref, test = labelled(spark, sf, fine=True)
    freq = ood.code_frequency(ref.union(test), "codes")
    n, total = freq.agg(F.count("*"), F.sum("freq")).first()
    run = running_totals(freq, [-F.col("freq"), F.col("code")], [])
    head, tail = F.col("position") <= F.ceil(F.lit(0.2) * n), F.col("position") > n - int(0.5 * n)
    share = lambda c: F.round(F.sum(F.when(c, F.col("freq"))) / total, 6)
    return run.agg(
        F.count("*").alias("labels"), share(head).alias("head20"), share(tail).alias("tail50"), F.round(F.avg((F.col("freq") == 1).cast("double")), 6).alias("singleton"),
        F.round(F.regr_slope(F.log("freq"), F.log("position")), 6).alias("zipf"),
    )


@query("""
select split, task, count(*) as rows, count(distinct label) as labels, min(length(aa_seq)) as shortest, median(length(aa_seq)) as middle, max(length(aa_seq)) as longest,
  count(*) filter (length(aa_seq) < 60 or length(aa_seq) > 1000) as extreme, round(avg(case when struct_source = 'PDB' then 1.0 else 0.0 end), 6) as measured from sample_multilabel group by all""")
def dataset_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Size, label count, lengths and structure sources a split and task."""
    n = F.length("aa_seq")
    return table(spark, sf, "sample_multilabel").groupBy("split", "task").agg(
        F.count("*").alias("rows"), F.count_distinct("label").alias("labels"), F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("middle"), F.max(n).alias("longest"),
        F.count_if((n < 60) | (n > 1000)).alias("extreme"), F.round(F.avg(F.coalesce((F.col("struct_source") == "PDB").cast("double"), F.lit(0.0))), 6).alias("measured"),
    )


_LADDER_ON = [90, 70, 50, 30]


@query(f"""
with o as (select *, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders),
t as (select o_orderkey, o_totalprice, o_custkey from o where rn > floor(n * (0.72::double + 0.08::double))), r as (select avg(o_totalprice) as m from o where rn <= floor(n * 0.72)),
h as (select query, max(score) as best from ({HITS}) group by query),
f as (select t.*, {', '.join(f'coalesce(best, 0) < {c} as s{c}' for c in _LADDER_ON)}, best is null as orphan from t left join h on query = o_orderkey),
l as (select *, 'all' as subset from f {' '.join(f"union all select *, 'seq_redundancy_{c}' from f where s{c}" for c in _LADDER_ON)} union all select *, 'ood_orphan' from f where orphan
  union all select *, 'ind' from f where not (orphan or {' or '.join(f's{c}' for c in _LADDER_ON)}))
select subset, count(*) as n, round(sqrt(avg((m - o_totalprice) * (m - o_totalprice))), 4) as rmse, round(avg(abs(m - o_totalprice)), 4) as mae from l, r group by subset""")
def time_split_ladder_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: time split, best hits, redundancy ladder, orphans and in-distribution rows, errors of every subset of
    the test rows in one aggregation (the prediction is the train mean)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    split = cut(share_split(o, [F.col("o_orderdate"), F.col("o_orderkey")], 0.72, 0.08))
    mean = split.where("split = 'train'").agg(F.avg("o_totalprice")).first()[0] or 0.0
    test = split.where("split = 'test'").select("o_orderkey", "o_totalprice")
    flagged = ood.with_best_hits(test, "o_orderkey", hits(spark, sf), _LADDER_ON)
    flags = [f"seq_redundancy_{c}" for c in _LADDER_ON] + ["ood_orphan"]
    rows = flagged.withColumn("ind", ood.ind(flags)).withColumn("all", F.lit(True))
    long = ood.true_flags(rows, ["all", "ind", *flags], ["o_totalprice"]).withColumn("m", F.lit(mean)).withColumnRenamed("flag", "subset")
    return metrics.regression(long, ["subset"], "m", "o_totalprice").select("subset", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query(f"""
with f as (select l_extendedprice as y, p_retailprice * l_quantity as p, {', '.join(f'2 * l_quantity < {c} as s{c}' for c in _LADDER_ON)} from lineitem join part on l_partkey = p_partkey),
l as (select y, p, 'all' as subset from f {' '.join(f"union all select y, p, 's{c}' from f where s{c}" for c in _LADDER_ON)})
select subset, count(*) as n, round(sqrt(avg((p - y) * (p - y))), 3) as rmse, round(avg(abs(p - y)), 3) as mae, round(coalesce(corr(p, y), 0), 6) as pearson from l group by subset""")
def regression_metrics_by_subset(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    flags = [f"s{c}" for c in _LADDER_ON]
    rows = table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("p"), F.lit(True).alias("all"), *[(2 * F.col("l_quantity") < c).alias(f"s{c}") for c in _LADDER_ON])
    long = ood.true_flags(rows, ["all", *flags], ["y", "p"]).withColumnRenamed("flag", "subset")
    return metrics.regression(long, ["subset"], "p", "y").select("subset", "n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("pearson", 6).alias("pearson"))


@query("""
with s as (select vec_id % 3 as subset, embedding[1]::double as x, (label < 5)::int as y from embeddings),
r as (select *, (rank() over (partition by subset order by x)) + (count(*) over (partition by subset, x) - 1) / 2.0 as ar from s),
a as (select subset, sum(y) as positives, sum(1 - y) as negatives, (sum(ar) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) as auroc from r group by subset),
d as (select subset, x, sum(y) as tp, count(*) as n from s group by all), c as (select subset, tp, sum(tp) over w as ctp, sum(n) over w as cn from d window w as (partition by subset order by x desc)),
p as (select subset, sum(tp * (ctp / cn)) as ap from c group by subset)
select a.subset, positives, negatives, round(auroc, 6) as auroc, round(coalesce(ap / nullif(positives, 0), 0), 6) as auprc from a join p on p.subset = a.subset""")
def auroc_auprc_by_subset(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("subset"), F.col("embedding")[0].cast("double").alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    return metrics.ranking(e, ["subset"], "x", "y").select("subset", "positives", "negatives", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


@query("""
with s as (select label as t, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as p from embeddings),
c as (select t as c, 1 as t, 0 as p, 0 as tp from s union all select p, 0, 1, (p = t)::int from s), f as (select c, 2.0 * sum(tp) / (sum(t) + sum(p)) as f1, sum(tp) as tp, sum(t) as t from c group by c)
select round(avg(f1), 6) as macro_f1, round(sum(tp) / sum(t), 6) as accuracy, round(sum(f1) / 10, 6) as macro_f1_all from f""")
def multiclass_accuracy_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.lit(0).alias("k"), F.col("label").alias("t"), metrics.argmax_class(F.slice("embedding", 1, 10)).alias("p"))
    return metrics.macro_f1(e, ["k"], "p", "t", 10).select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1_all", 6).alias("macro_f1_all"))


@query("""
with s as (select vec_id, i - 1 as c, 1 / (1 + exp(-8 * embedding[i]::double)) as x, (label = i - 1)::int as y from embeddings, (select unnest(range(1, 11)) as i)),
g as (select unnest(range(500)) as k), n as (select count(*) as n from embeddings), t as (select vec_id, sum(y) as truth from s group by vec_id),
m as (select vec_id, k, sum(y) as tp, count(*) as said from s join g on least(floor((x - 0.01) / (0.98 / 499) + 1e-9), 499) >= k and x >= 0.01 group by all),
c as (select k, sum(tp / said) / max(n) as p, sum(case when truth > 0 then tp / truth else 0 end) / max(n) as r from m join t using (vec_id), n group by k)
select round(0.01 + k * (0.98 / 499), 6) as threshold, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r + 1e-10), 6) as f1 from c order by round(2 * p * r / (p + r + 1e-10), 12) desc, k limit 1""")
def fmax_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Sample-centred maximum F over a fixed grid of 500 thresholds."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("c", "x"))
    s = e.select("vec_id", (1 / (1 + F.exp(-8 * F.col("x").cast("double")))).alias("score"), (F.col("label") == F.col("c")).cast("bigint").alias("y"))
    return metrics.fmax(s, "vec_id", "score", "y").select(*[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall", "f1")])
