"""Text, array, similarity and sampling queries, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oodmill.functions import arrays, text
from oodmill.operators import similarity
from oodmill.operators.graph import connected_components
from oodmill.session import cut, merged, table

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
select row_id, md5(regexp_replace(upper(aa_seq), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) as stripped, md5(regexp_replace(translate(upper(aa_seq), 'BZJUO', 'NQLCK'), '[^ACDEFGHIKLMNPQRSTVWY]', 'A', 'g')) as mapped,
  md5(translate(aa_seq, 'XBZJU', '')) as dropped from sample_multilabel""")
def seq_clean_variants(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("aa_seq")
    return table(spark, sf, "sample_multilabel").select("row_id", F.md5(text.clean_strip(s)).alias("stripped"), F.md5(text.clean_map(s)).alias("mapped"), F.md5(text.clean_drop(s)).alias("dropped"))


@query("""
select ch, count(*) as n, count(distinct row_id) as rows from (select row_id, unnest(string_split(aa_seq, '')) as ch from sample_multilabel) where ch <> '' group by ch""")
def legality_scan(spark: SparkSession, sf: str) -> DataFrame:
    """How often each character stands in the sequences; characters are counted a row before they are shuffled."""
    chars = table(spark, sf, "sample_multilabel").select("row_id", F.explode(F.split("aa_seq", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("row_id", "ch").agg(F.count("*").alias("k")).groupBy("ch").agg(F.sum("k").alias("n"), F.count("*").alias("rows"))


_EC = "(p_size % 6 + 1)::varchar || '.' || (p_size % 4 + 1)::varchar || '.' || (p_partkey % 7 + 1)::varchar || case when p_partkey % 3 = 0 then '' else '.' || (p_partkey % 5 + 1)::varchar end"


@query(f"""
with c as (select p_partkey, {_EC} as ec from part)
select p_partkey, len(string_split(ec, '.')) as level, case when len(string_split(ec, '.')) = 4 then ec else ec || '.-' end as padded, array_to_string(string_split(ec, '.')[1:3], '.') || '.-' as third from c""")
def ec_level_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    n = lambda e: F.expr(e).cast("string")
    last = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), n("p_partkey % 5 + 1")))
    ec = F.concat(F.concat_ws(".", n("p_size % 6 + 1"), n("p_size % 4 + 1"), n("p_partkey % 7 + 1")), last)
    c = p.select("p_partkey", ec.alias("ec"))
    return c.select("p_partkey", text.ec_level(F.col("ec")).cast("bigint").alias("level"), text.ec_padded(F.col("ec")).alias("padded"), text.ec_third_level(F.array("ec"))[0].alias("third"))


_AFF = "(case l_linenumber % 3 when 0 then 'Kd' when 1 then 'Ki' else 'IC50' end) || (case when l_quantity > 40 then '<' else '=' end) || (l_quantity::int)::varchar || (case l_suppkey % 3 when 0 then 'nM' when 1 then 'uM' else 'mM' end)"


@query(f"""
with a as (select {_AFF} as t, l_quantity, l_suppkey, l_linenumber from lineitem)
select regexp_extract(t, '^([A-Za-z0-9]+?)[=<]', 1) as kind, regexp_extract(t, '([=<])', 1) as relation, count(*) as n,
  round(avg(-log10(l_quantity * case l_suppkey % 3 when 0 then 1e-9 when 1 then 1e-6 else 1e-3 end)), 6) as mean_p from a group by all""")
def affinity_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Affinity texts to kind, relation and -log10 of the molar value."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Kd").when(F.col("l_linenumber") % 3 == 1, "Ki").otherwise("IC50")
    unit = F.when(F.col("l_suppkey") % 3 == 0, "nM").when(F.col("l_suppkey") % 3 == 1, "uM").otherwise("mM")
    t = F.concat(kind, F.when(F.col("l_quantity") > 40, "<").otherwise("="), F.col("l_quantity").cast("int").cast("string"), unit)
    a = table(spark, sf, "lineitem").select(text.affinity(t).alias("a")).select("a.*")
    return a.groupBy("kind", "relation").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""
with w as (select doc_id, unnest({_WORDS}) as term from documents where text is not null), n as (select count(*) as n from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from w group by all), df as (select term, count(*) as df from tf group by term),
x as (select doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as v from tf join df on df.term = tf.term, n),
l as (select doc_id, sqrt(sum(v * v)) as l from x group by doc_id)
select x.doc_id, count(*) as terms, round(max(v / l), 5) as top_weight, round(sum(v / l), 3) as total from x join l on l.doc_id = x.doc_id group by x.doc_id""")
def tfidf_l2(spark: SparkSession, sf: str) -> DataFrame:
    """Sublinear TF-IDF with unit length, one summary a document; term counts are taken before document counts."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    n = docs.count()
    tf = cut(docs.select("doc_id", F.explode(text.words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(merged(df), "term").select("doc_id", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("v"))
    by = x.groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("v").alias("m"), F.sum("v").alias("s"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return by.select("doc_id", "terms", F.round(F.col("m") / F.col("l"), 5).alias("top_weight"), F.round(F.col("s") / F.col("l"), 3).alias("total"))


@query(f"""
with w as (select doc_id, list_filter({_WORDS}, lambda w: length(w) > 1) as w from documents where text is not null),
g as (select doc_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) as k from w)
select k as keyword, count(*) as docs from g group by k""")
def bigram_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select(F.filter(text.words(F.col("text")), lambda x: F.length(x) > 1).alias("w"))
    return docs.select(F.explode(text.ngrams(F.col("w"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("docs"))


_BITS = "list_filter(range(0, len(embedding)), lambda i: embedding[i + 1] > 0)"


@query(f"""
with b as (select vec_id, unnest({_BITS}) as bit from embeddings), n as (select vec_id, count(*) as n from b group by vec_id),
s as (select q.vec_id as q, r.vec_id as r, count(*) as s from b q join b r on q.bit = r.bit where q.vec_id % 100 = 0 and q.vec_id <> r.vec_id group by all)
select e.vec_id, round(coalesce(max(s / (x.n + y.n - s)), 0), 6) as best from embeddings e left join s on s.q = e.vec_id left join n x on x.vec_id = q left join n y on y.vec_id = r where e.vec_id % 100 = 0 group by 1""")
def tanimoto_max_to_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest fingerprint similarity of the stated query set (ids divisible by 100) to all other rows."""
    e = table(spark, sf, "embeddings").select("vec_id", arrays.on_bits(F.col("embedding")).alias("bits"))
    return similarity.best_reference(e.where("vec_id % 100 = 0"), e, "vec_id", "bits").select("vec_id", F.round("best", 6).alias("best"))


_TOP = "list_slice(list_transform(list_reverse_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'v': embedding[i], 'i': i})), lambda x: x.i), 1, 12)"


def _top_bits(e: DataFrame) -> DataFrame:
    """The twelve greatest places of each vector as its fingerprint."""
    ranked = F.reverse(F.array_sort(F.transform("embedding", lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i")))))
    return e.select("vec_id", F.transform(F.slice(ranked, 1, 12), lambda s: s["i"]).alias("bits"))


@query(f"""
with b as (select vec_id, unnest({_TOP}) as bit from embeddings), s as (select x.vec_id as a, y.vec_id as b, count(*) as s from b x join b y on x.bit = y.bit and x.vec_id < y.vec_id group by all)
select a, b, round(s / (24 - s), 6) as jaccard from s where s / (24 - s) >= 0.5""")
def tanimoto_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of fingerprints at 0.5 or more, exactly, through a join of rare-first prefixes."""
    pairs = similarity.prefix_pairs(_top_bits(table(spark, sf, "embeddings")), "vec_id", "bits", 0.5)
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def greedy_clique_partition(spark: SparkSession, sf: str) -> DataFrame:
    e = _top_bits(table(spark, sf, "embeddings"))
    return similarity.clique_partition(e, "vec_id", cut(similarity.prefix_pairs(e, "vec_id", "bits", 0.5)))


_SPLIT = "case when vec_id % 10 < 7 then 'train' when vec_id % 10 = 7 then 'val' else 'test' end"


@query(f"""
with recursive b as (select vec_id, unnest({_TOP}) as bit from embeddings), s as (select x.vec_id as a, y.vec_id as b, count(*) as s from b x join b y on x.bit = y.bit and x.vec_id <> y.vec_id group by all),
p as (select a, b from s where s / (24 - s) >= 0.5), t(id) as (select vec_id from embeddings where vec_id % 10 < 7 union select p.a from t join p on p.b = t.id)
select vec_id, case when vec_id in (select id from t) then 'train' else {_SPLIT} end as split from embeddings""")
def leakage_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows similar to train move there until none is left that is."""
    e = table(spark, sf, "embeddings")
    pairs = similarity.prefix_pairs(_top_bits(e), "vec_id", "bits", 0.5)
    m = F.col("vec_id") % 10
    split = F.when(m < 7, "train").when(m == 7, "val").otherwise("test")
    return similarity.leakage_fixpoint(e.select("vec_id", split.alias("split")), "vec_id", "split", pairs)


@query("""
with recursive e as (select distinct 'c' || o_custkey as u, 'd' || strftime(o_orderdate, '%Y%m%d') as v from orders), b as (select u as a, v as b from e union select v, u from e),
r(n, l) as (select a, a from b union select b.b, r.l from r join b on b.a = r.n and r.l < b.b) select n as node, min(l) as component from r group by n""")
def connected_components_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd")).alias("v")).distinct()
    return connected_components(o)


@query("""
with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)
select l.vec_id as l, r.vec_id as r, round(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2), 6) as distance from p l join p r on l.vec_id <> r.vec_id and l.vec_id % 100 = 0
  and (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z) <= 0.05 * 0.05""")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """Points near those of the stated query set, by a grid of cells."""
    p = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return similarity.radius_pairs(p.where("vec_id % 100 = 0"), p, "vec_id", ("x", "y", "z"), 0.05).where("l <> r").select("l", "r", F.round("distance", 6).alias("distance"))


@query("""
with p as (select l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity from lineitem),
d as (select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b, a.l_partkey as pa, b.l_partkey as pb, abs(a.l_extendedprice - b.l_extendedprice) as distance from p a join p b on a.l_orderkey = b.l_orderkey and (a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_quantity) <> (b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_quantity)),
r as (select *, row_number() over (partition by l_orderkey, a, pa order by distance, b, pb) as k from d) select l_orderkey, a, pa, k, round(distance, 2) as distance from r where k <= 2""")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest other lines of each order line (lines of an order are few and bounded)."""
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    other = [c for c in p.columns if c not in ("l_orderkey", "l_extendedprice")]
    b = p.select("l_orderkey", *[F.col(c).alias(f"{c}_b") for c in p.columns if c != "l_orderkey"])
    same = F.lit(True)
    for c in other:
        same = same & (F.col(c) == F.col(f"{c}_b"))
    d = p.join(b, "l_orderkey").where(~same).withColumn("distance", F.abs(F.col("l_extendedprice") - F.col("l_extendedprice_b")))
    w = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("distance", "l_linenumber_b", "l_partkey_b")
    ranked = d.withColumn("k", F.row_number().over(w)).where("k <= 2")
    return ranked.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("pa"), "k", F.round("distance", 2).alias("distance"))


@query("""
with q as (select r, p_partkey as x, row_number() over (partition by r order by md5('a' || r::varchar || p_partkey::varchar), p_partkey) as i, row_number() over (partition by r order by md5('b' || r::varchar || p_partkey::varchar), p_partkey) as j from part, (select unnest(range(0, 6)) as r)),
d as (select least(u.x, v.x) as a, greatest(u.x, v.x) as b, min(u.r) as r from q u join q v on u.r = v.r and u.i = v.j group by all), k as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem)
select d.a, d.b from d anti join k on k.a = d.a and k.b = d.b order by r, md5(d.a::varchar || ':' || d.b::varchar), d.a, d.b limit (select count(*) from part)""")
def negative_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """As many random unknown pairs as entities."""
    known = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return similarity.negative_pairs(table(spark, sf, "part").select("p_partkey"), "p_partkey", known)


@query("""
with k as (select row_id, task, list_distinct(list_transform(range(1, greatest(length(aa_seq) - 1, 1)), lambda i: substr(aa_seq, i, 3))) as k from sample_multilabel where length(aa_seq) >= 3)
select task, count(*) as rows, sum(len(k)) as kmers from k group by task""")
def kmer_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sample_multilabel").where(F.length("aa_seq") >= 3).select("task", F.size(similarity.kmers(F.col("aa_seq"), 3)).alias("k"))
    return s.groupBy("task").agg(F.count("*").alias("rows"), F.sum("k").alias("kmers"))


@query("select doc_id from documents where md5(text) in (select md5(text) from documents where text is not null group by md5(text) having count(*) > 1)")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All rows whose text stands more than once."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").count().where("count > 1").select("h"), "h", "left_semi").select("doc_id")
