"""Curation queries over the domain tables: vocabularies, conflicts, priorities, blocked duplicates, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.functions import text
from oodmill.operators import alignment, ood, similarity
from oodmill.operators.ranked import descending, first_per_group, nulls_last, running_totals
from oodmill.plans.novelty import FLAGS, HITS, hits
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


@query("select term, row_number() over (order by term) - 1 as idx from (select distinct trim(t) as term from (select unnest(string_split(label, ';')) as t from sample_multilabel) where trim(t) <> '')")
def label_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct tokens numbered from 0."""
    tokens = table(spark, sf, "sample_multilabel").select(F.explode(text.tokens(F.col("label"))).alias("term")).distinct()
    return running_totals(tokens, [F.col("term")], []).select("term", (F.col("position") - 1).alias("idx"))


@query("""
select row_id, case when count(*) over (partition by unique_id) > 1 then unique_id || '-' || left(md5(row_id::varchar || coalesce(aa_seq, '')), 8) else unique_id end as unique_name
from sample_multilabel where unique_id is not null""")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that stand more than once get a hash of their content; counts are joined back, not windowed."""
    s = table(spark, sf, "sample_multilabel").where("unique_id is not null").select("row_id", "unique_id", "aa_seq")
    n = s.groupBy("unique_id").agg(F.count("*").alias("n"))
    tag = F.left(F.md5(F.concat(F.col("row_id").cast("string"), F.coalesce("aa_seq", F.lit("")))), F.lit(8))
    return s.join(n, "unique_id").select("row_id", F.when(F.col("n") > 1, F.concat_ws("-", "unique_id", tag)).otherwise(F.col("unique_id")).alias("unique_name"))


@query("""
with g as (select uniprot, count(distinct label) as labels, count(*) as rows from sample_multilabel where uniprot is not null and label is not null group by 1)
select case when labels = 1 then 'agree' else 'conflict' end as state, count(*) as groups, sum(rows) as rows from g group by 1""")
def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "sample_multilabel").where("uniprot is not null and label is not null").groupBy("uniprot").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("rows"))
    return g.groupBy(F.when(F.col("labels") == 1, "agree").otherwise("conflict").alias("state")).agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"))


@query("""
with u as (select distinct unique_id, lower(trim(split)) as split from sample_multilabel where unique_id is not null and split is not null)
select a.split as a, b.split as b, count(*) as shared from u a join u b on a.unique_id = b.unique_id and a.split < b.split group by all""")
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that two splits share: the few splits of an identifier are gathered first, then paired."""
    u = table(spark, sf, "sample_multilabel").where("unique_id is not null and split is not null").groupBy("unique_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("split")))).alias("s"))
    pairs = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as a, y as b))))")
    return u.where("size(s) > 1").select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


@query("""
select pdb_id, row_id, case when has_apo = 1 then 3 when has_predicted = 1 then 2 when resolution is not null and not isnan(resolution) then 1 else 0 end as score from
  (select *, row_number() over (partition by pdb_id order by case when has_apo = 1 then 3 when has_predicted = 1 then 2 when resolution is not null and not isnan(resolution) then 1 else 0 end desc,
  case when isnan(resolution) then null else resolution end nulls last, row_id) as rn from ppi_pairs_corrected_seq95 where pdb_id is not null) where rn = 1""")
def structure_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal quality score of the structure source and the best record of each entry by it."""
    res = F.when(~F.isnan("resolution"), F.col("resolution"))
    score = F.when(F.col("has_apo") == 1, 3).when(F.col("has_predicted") == 1, 2).when(res.isNotNull(), 1).otherwise(0)
    df = table(spark, sf, "ppi_pairs_corrected_seq95").where("pdb_id is not null").select("pdb_id", "row_id", res.alias("res"), score.alias("score"))
    return first_per_group(df, ["pdb_id"], [descending(F.col("score")), nulls_last(F.col("res")), F.col("row_id")]).select("pdb_id", "row_id", "score")


_K5 = "list_distinct(list_transform(range(1, length(aa_seq) - 3), lambda i: substr(aa_seq, i, 5)))"


@query(f"""
with s as (select aa_seq, min(row_id) as id from sample_multilabel where length(aa_seq) >= 5 group by aa_seq), k as (select id, unnest({_K5}) as k from s), n as (select id, count(*) as n from k group by id),
p as (select x.id as a, y.id as b, count(*) as s from k x join k y on x.k = y.k and x.id < y.id group by all)
select a, b, round(s / (m.n + o.n - s), 6) as jaccard from p join n m on m.id = a join n o on o.id = b where s / (m.n + o.n - s) >= 0.5""")
def kmer_blocked_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of distinct sequences whose 5-mer sets reach 0.5: met on stretches of 5-mers, verified exactly."""
    s = table(spark, sf, "sample_multilabel").where(F.length("aa_seq") >= 5).groupBy("aa_seq").agg(F.min("row_id").alias("id"))
    return similarity.window_pairs(s, "id", "aa_seq", 5, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def aligned_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment identity of the pairs that k-mers bring together."""
    s = table(spark, sf, "sample_multilabel").where(F.length("aa_seq") >= 5).groupBy("aa_seq").agg(F.min("row_id").alias("id"))
    both = cut(similarity.window_pairs(s, "id", "aa_seq", 5, 0.5))
    return alignment.with_identity(both, "x", "y").select("a", "b", F.round("identity", 6).alias("identity"))


@query(f"""
with h as (select query, max(score) as best from ({HITS}) group by query), t as (select * from orders where o_orderdate >= timestamp '2000-06-01')
select o_orderkey, o_custkey from t where o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1996-01-01') and o_orderkey not in (select query from h where best >= 95)""")
def contamination_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows left after those that share an entity with the reference or hit it at 95 or more are removed."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    known = o.where(F.col("o_orderdate") < at("1996-01-01")).select("o_custkey")
    close = ood.best_hits(hits(spark, sf)).where("best >= 95").select(F.col("query").alias("o_orderkey"))
    return o.where(F.col("o_orderdate") >= at("2000-06-01")).join(known, "o_custkey", "left_anti").join(close, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


FAMILIES = {"seq": [f for f in FLAGS if f.startswith("seq")], "tm": [f for f in FLAGS if f.startswith("tm")], "extreme": ["ood_extremeshort", "ood_extremelong"]}


@query(
    "with c as ("
    + " union all ".join(f"select dataset, '{fam}' as family, '{f}' as axis, count(*) filter ({f}) as n from ood_flags group by dataset" for fam, fs in FAMILIES.items() for f in fs)
    + ") select dataset, family, arg_max(axis, (n, axis)) as axis, max(n) as n from c group by all"
)
def representative_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Of each family of flags the one that is True most often, a task; ties to the later name."""
    counted = table(spark, sf, "ood_flags").groupBy("dataset").agg(*[F.count_if(f).alias(f) for fs in FAMILIES.values() for f in fs])
    best = lambda fs: F.array_max(F.array(*[F.struct(F.col(f).alias("n"), F.lit(f).alias("axis")) for f in fs]))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), best(fs).alias("b")) for k, fs in FAMILIES.items()]))
    return counted.select("dataset", rows.alias("r")).select("dataset", "r.family", F.col("r.b.axis").alias("axis"), F.col("r.b.n").alias("n"))


@query("""
select struct_source, split_part(coalesce(struct_file, ''), '.', -1) as ext, count(*) as n, count(*) filter (lower(struct_file) like 'af-%') as predicted from sample_multilabel group by all""")
def structure_sources(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.split(F.coalesce("struct_file", F.lit("")), r"\."), -1)
    return table(spark, sf, "sample_multilabel").groupBy("struct_source", ext.alias("ext")).agg(F.count("*").alias("n"), F.count_if(text.is_predicted(F.col("struct_file"))).alias("predicted"))


@query("""
with r as (select row_id, string_agg(l, ';' order by l) as labels from (select distinct row_id, trim(t) as l from (select row_id, unnest(string_split(label, ';')) as t from sample_multilabel where lower(trim(split)) = 'test')
  where trim(t) <> '' and trim(t) in (select trim(u) from (select unnest(string_split(label, ';')) as u from sample_multilabel where lower(trim(split)) = 'train'))) group by row_id) select row_id, labels from r""")
def labels_seen_in_train(spark: SparkSession, sf: str) -> DataFrame:
    """Test labels cut to the train vocabulary; rows left without a label fall away."""
    s = table(spark, sf, "sample_multilabel").select("row_id", F.lower(F.trim("split")).alias("split"), F.explode(text.tokens(F.col("label"))).alias("l"))
    vocabulary = s.where("split = 'train'").select("l").distinct()
    kept = s.where("split = 'test'").select("row_id", "l").distinct().join(vocabulary, "l", "left_semi")
    return kept.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("l")), ";").alias("labels"))


@query("select case when " + " or ".join(f"coalesce({f}, false)" for f in ("seq_redundancy_30", "tm_score_0_3")) + " then 'far' else 'near' end as zone, count(*) as n, round(avg(idr_ratio) filter (idr_ratio between 0 and 1), 6) as idr from ood_flags group by 1")
def far_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise OR over optional flags, NULL as False, and a mean over usable values only."""
    far = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in ("seq_redundancy_30", "tm_score_0_3")])
    return table(spark, sf, "ood_flags").groupBy(F.when(far, "far").otherwise("near").alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("idr_ratio").between(0, 1), F.col("idr_ratio"))), 6).alias("idr"))
