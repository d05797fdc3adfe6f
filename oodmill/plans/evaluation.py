"""Evaluation by kind of task, null predictors and overlap of axes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.functions import text
from oodmill.operators import evaluation, metrics, ood
from oodmill.operators.ranked import running_totals
from oodmill.plans.novelty import FLAGS
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


# class scores of the embeddings, in hundredths so that they have ties and few distinct values
_SCORES = "s as (select vec_id as r, vec_id % 3 as subset, i - 1 as label, round(1 / (1 + exp(-8 * embedding[i]::double)), 2) as x, (label = i - 1 or label + 1 = i - 1)::int as y from embeddings, (select unnest(range(1, 11)) as i))"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("t"), F.posexplode(F.slice("embedding", 1, 10)).alias("label", "v"))
    return e.select(F.col("vec_id").alias("row"), (F.col("vec_id") % 3).alias("subset"), "label", F.round(1 / (1 + F.exp(-8 * F.col("v").cast("double"))), 2).alias("score"), ((F.col("t") == F.col("label")) | (F.col("t") + 1 == F.col("label"))).cast("bigint").alias("y"))


def _ap(keys: str) -> str:
    """Average precision over distinct scores, by SQL."""
    by, over = (f"group by {keys}", f"partition by {keys}") if keys else ("", "")
    cols = f"{keys}, " if keys else ""
    return (
        f"(select {cols}coalesce(sum(tp * (ctp / cn)) / nullif(sum(tp), 0), 0) as ap, sum(tp) as p from (select {cols}tp, sum(tp) over w as ctp, sum(n) over w as cn from"
        f" (select {cols}x, sum(y) as tp, count(*) as n from s group by {cols}x) window w as ({over} order by x desc)) {by})"
    )


@query(f"""
with {_SCORES} select a.subset, round(a.ap, 6) as micro_aupr, round(avg(b.ap) filter (b.p > 0), 6) as macro_aupr from {_ap('subset')} a join {_ap('subset, label')} b on a.subset = b.subset group by a.subset, a.ap""")
def micro_macro_aupr(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.label_aupr(scores(spark, sf), ["subset"], "label", "score", "y")
    return got.select("subset", F.round("micro_aupr", 6).alias("micro_aupr"), F.round("macro_aupr", 6).alias("macro_aupr"))


def _fmax(source: str, thresholds: str) -> str:
    """Best threshold of all in `thresholds`, for each subset, by SQL."""
    return f"""t as (select subset, r, sum(y) as truth from {source} group by all), n as (select subset, count(*) as n from t group by all), g as ({thresholds}),
m as (select {source}.subset, r, k, sum(y) as tp, count(*) as said from {source} join g on x >= k and g.subset = {source}.subset group by all),
c as (select m.subset, k, sum(tp / said) / max(n) as p, sum(case when truth > 0 then tp / truth else 0 end) / max(n) as rc from m join t on t.subset = m.subset and t.r = m.r join n on n.subset = m.subset group by all),
f as (select subset, k, 2 * p * rc / (p + rc + 1e-10) as f1, row_number() over (partition by subset order by round(2 * p * rc / (p + rc + 1e-10), 12) desc, k) as rn from c)"""


@query(f"with {_SCORES}, d as (select distinct x from s), {_fmax('s', 'select subset, x as k from (select distinct subset from s), d')} select subset, k as threshold, round(f1, 6) as f1 from f where rn = 1")
def fmax_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum F over the distinct scores as thresholds, for each subset in one pass."""
    return metrics.fmax(scores(spark, sf), "row", "score", "y", "distinct", ["subset"]).select("subset", "threshold", F.round("f1", 6).alias("f1"))


@query(f"""
with {_SCORES}, v as (select * from s where subset = 0), e as (select * from s where subset > 0), {_fmax('v', 'select distinct 0 as subset, x as k from s where subset = 0')},
b as (select k from f where rn = 1), te as (select subset, r, sum(y) as truth from e group by all), me as (select e.subset, r, sum(y) as tp, count(*) as said from e, b where x >= k group by all),
ce as (select te.subset, avg(coalesce(tp / said, 0)) as p, avg(case when truth > 0 then coalesce(tp, 0) / truth else 0 end) as rc from te left join me on me.subset = te.subset and me.r = te.r group by all)
select subset, k as threshold, round(2 * p * rc / (p + rc + 1e-10), 6) as f1 from ce, b""")
def fmax_validated(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold chosen on validation rows and held fixed on the others."""
    s = cut(scores(spark, sf))
    best = metrics.fmax(s.where("subset = 0"), "row", "score", "y", "distinct").first()["threshold"]
    return metrics.fmax(s.where("subset > 0"), "row", "score", "y", [best], ["subset"]).select("subset", "threshold", F.round("f1", 6).alias("f1"))


@query(f"""
with {_SCORES}, d as (select label, x, sum(y) as tp, count(*) as n from s group by all), c as (select label, sum(tp) over w as ctp, sum(n) over w as cn from d window w as (partition by label order by x desc)), p as (select label, sum(y) as p from s group by 1)
select round(avg(f), 6) as macro_fmax, count(*) as classes from (select label, max(2.0 * ctp / (cn + p)) as f from c join p using (label) where p > 0 group by label)""")
def macro_fmax(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.macro_fmax(scores(spark, sf), "label", "score", "y")
    return got.select(F.round("macro_fmax", 6).alias("macro_fmax"), "classes")


_RANKS = "r as (select *, rank() over (partition by subset order by x) + (count(*) over (partition by subset, x) - 1) / 2.0 as ra, rank() over (partition by subset order by y) + (count(*) over (partition by subset, y) - 1) / 2.0 as rb from s)"


@query(f"""
with s as (select l_returnflag as subset, l_quantity as x, l_extendedprice as y from lineitem union all select 'one', 1, 2 union all select 'constant', 1, l_linenumber from lineitem where l_orderkey < 50), {_RANKS}
select subset, case when count(*) > 1 and stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then round(corr(ra, rb), 6) end as spearman from r group by subset""")
def spearman_by_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of each subset; NULL for one row or a constant side."""
    l = table(spark, sf, "lineitem")
    rows = l.select(F.col("l_returnflag").alias("subset"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    rows = rows.union(spark.range(1).select(F.lit("one"), F.lit(1.0), F.lit(2.0))).union(l.where("l_orderkey < 50").select(F.lit("constant"), F.lit(1.0), F.col("l_linenumber").cast("double")))
    return metrics.spearman(rows, ["subset"], "a", "b").select("subset", F.round("spearman", 6).alias("spearman"))


# residues: the events of a user in a label of -1, 0 or 1 each
_RESIDUES = "s as (select user_id % 4 as subset, value / 100.0 as x, case event_type when 'error' then 1 when 'click' then 0 else -1 end as y from events)"


def residues(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 0).otherwise(-1)
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("subset"), (F.col("value") / 100.0).alias("score"), y.alias("y"))


@query(f"""
with {_RESIDUES}, v as (select * from s where y >= 0), r as (select *, rank() over (partition by subset order by x) + (count(*) over (partition by subset, x) - 1) / 2.0 as ra from v),
a as (select subset, (sum(ra) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) as auroc, avg((y = (x >= 0.5)::int)::int) as accuracy,
  coalesce(2.0 * count(*) filter (y = 1 and x >= 0.5) / nullif(2.0 * count(*) filter (y = 1 and x >= 0.5) + count(*) filter (y = 0 and x >= 0.5) + count(*) filter (y = 1 and x < 0.5), 0), 0) as f1 from r group by subset)
select a.subset, round(auroc, 6) as auroc, round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(ap, 6) as aupr from a join {_ap('subset').replace('from s group', 'from v group')} b on a.subset = b.subset""")
def residue_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, AUROC, average precision and F1 over the valid residues of each subset of proteins."""
    v = residues(spark, sf).where("y >= 0")
    right = v.groupBy("subset").agg(F.round(F.avg((F.col("y") == (F.col("score") >= 0.5).cast("int")).cast("double")), 6).alias("accuracy"))
    both = metrics.ranking(v, ["subset"], "score", "y").join(metrics.binary_f1(v, ["subset"], "score", "y"), "subset").join(right, "subset")
    return both.select("subset", F.round("auroc", 6).alias("auroc"), "accuracy", F.round("f1", 6).alias("f1"), F.round("auprc", 6).alias("aupr"))


@query(f"""
with s as (select l_returnflag as subset, p_retailprice * l_quantity as x, l_extendedprice as y from lineitem join part on l_partkey = p_partkey), {_RANKS},
reg as (select subset, sqrt(avg((x - y) * (x - y))) as rmse, avg(abs(x - y)) as mae, corr(x, y) as pearson, corr(ra, rb) as spearman from r group by subset),
c as (select (vec_id % 2)::varchar as subset, label as t, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as p from embeddings),
cc as (select subset, t as c, 1 as t, 0 as p, 0 as tp from c union all select subset, p, 0, 1, (p = t)::int from c), cf as (select subset, c, 2.0 * sum(tp) / (sum(t) + sum(p)) as f1, sum(tp) as tp, sum(t) as t from cc group by all),
cls as (select subset, sum(tp) / sum(t) as accuracy, avg(f1) as macro_f1 from cf group by subset),
l as (select 'price' as task, subset, unnest(['rmse', 'mae', 'pearson', 'spearman']) as metric, unnest([rmse, mae, pearson, spearman]) as value from reg union all select 'class', subset, unnest(['accuracy', 'macro_f1']), unnest([accuracy, macro_f1]) from cls)
select task, subset, metric, round(value, 4) as value, false as failed from l union all select 'broken', null, null, null, true""")
def task_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of several tasks by their kinds in one table; a task that cannot be read leaves its error alone."""

    def price() -> DataFrame:
        part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        rows = table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_returnflag").alias("subset"), (F.col("p_retailprice") * F.col("l_quantity")).alias("score"), F.col("l_extendedprice").alias("y"))
        return evaluation.evaluate(rows, "regression", ["subset"])

    def classes() -> DataFrame:
        rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 2).cast("string").alias("subset"), F.col("label").alias("y"), metrics.argmax_class(F.slice("embedding", 1, 10)).alias("pred"))
        return evaluation.evaluate(rows, "single_label", ["subset"])

    def broken() -> DataFrame:
        return table(spark, sf, "no_such_table")

    every = evaluation.evaluate_all({"price": price, "class": classes, "broken": broken}, "subset string, metric string, value double", spark)
    return every.select("task", "subset", "metric", F.round("value", 4).alias("value"), F.col("error").isNotNull().alias("failed"))


@query(f"""
with {_RESIDUES}, v as (select * from s where y >= 0), a as (select subset, coalesce(2.0 * count(*) filter (y = 1 and x >= 0.5) / nullif(2.0 * count(*) filter (y = 1 and x >= 0.5) + count(*) filter (y = 0 and x >= 0.5) + count(*) filter (y = 1 and x < 0.5), 0), 0) as f1 from v group by subset)
select a.subset, unnest(['aupr', 'f1']) as metric, round(unnest([ap, f1]), 6) as value from a join {_ap('subset').replace('from s group', 'from v group')} b on a.subset = b.subset""")
def residual_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Residue labels of two classes through the dispatch by kind; masked ones are left out."""
    return evaluation.evaluate(residues(spark, sf), "residual", ["subset"]).select("subset", "metric", F.round("value", 6).alias("value"))


@query("select * from (values ('price', 'regression'), ('line', 'single_label'), ('flag', 'binary'), ('terms', 'multilabel'), ('mask', 'residual'), ('segment', 'single_label')) t(source, kind)")
def task_types(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of tasks told from the first labels of a column."""
    l, p, c = (table(spark, sf, t) for t in ("lineitem", "part", "customer"))
    sources = {
        "price": (p, F.col("p_retailprice") + 0.5, "p_partkey"), "line": (l, F.col("l_linenumber"), "l_orderkey"), "flag": (c, (F.col("c_acctbal") < 0).cast("int"), "c_custkey"),
        "terms": (p, F.concat_ws(";", "p_brand", "p_type"), "p_partkey"), "mask": (p, F.concat(F.lit("["), F.col("p_size"), F.lit(" 0]")), "p_partkey"), "segment": (c, F.col("c_mktsegment"), "c_custkey"),
    }
    return spark.createDataFrame([(k, metrics.task_type(d.select(c.alias("y"), o), "y", o)) for k, (d, c, o) in sources.items()], "source string, kind string")


@query("""
select row_id, len(list_distinct(list_filter(list_transform(string_split_regex(coalesce(label, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> ''))) as tokens, try_cast(trim(label) as double) is not null as number, length(trim(label)) as name from sample_multilabel""")
def parsed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label texts read as the kinds of tasks do: a set of tokens, a number, a class name."""
    c = F.col("label")
    return table(spark, sf, "sample_multilabel").select("row_id", F.size(evaluation.parse_labels(c, "multilabel")).cast("bigint").alias("tokens"), evaluation.parse_labels(c, "regression").isNotNull().alias("number"), F.length(evaluation.parse_labels(c, "single_label")).cast("bigint").alias("name"))


@query("""
with t as (select *, p_partkey % 10 < 7 as train from part), m as (select median(p_retailprice) as med from t where train), k as (select p_brand, count(*) as n from t where train group by 1),
top as (select p_brand from k order by n desc, p_brand limit 1), r as (select avg((p_size > 25)::int) as rate from t where train)
select round(avg(abs(p_retailprice - med)), 4) as mae_median, round(avg(abs(p_retailprice)), 4) as mae_zero, round(avg((t.p_brand = top.p_brand)::int), 6) as accuracy_prior, round(any_value(rate), 6) as positive_rate from t, m, top, r where not train""")
def null_predictors(spark: SparkSession, sf: str) -> DataFrame:
    """What predictors that know no row reach: train median, zero, the commonest class, the positive rate."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand", (F.col("p_size") > 25).cast("double").alias("y"))
    train, test = p.where("p_partkey % 10 < 7"), p.where("p_partkey % 10 >= 7")
    common = evaluation.label_prior(train, "p_brand").orderBy(F.desc("prior"), "label").first()["label"]
    both = metrics.null_errors(train, test, "p_retailprice")
    rate = train.agg(F.avg("y")).first()[0]
    return both.agg(
        F.round(F.avg(F.abs(F.col("p_retailprice") - F.col("null_median"))), 4).alias("mae_median"), F.round(F.avg(F.abs("p_retailprice")), 4).alias("mae_zero"),
        F.round(F.avg((F.col("p_brand") == common).cast("double")), 6).alias("accuracy_prior"), F.round(F.lit(rate), 6).alias("positive_rate"),
    )


@query("""
with l as (select least(l_linenumber - 2, 2) as label from lineitem where l_linenumber - 2 >= 0) select label::int as label, round(count(*) / sum(count(*)) over (), 6) as prior from l group by label""")
def residue_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the residue labels of training rows, clipped to three classes, masked ones left out."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") - 2).alias("labels"))
    return evaluation.residue_prior(rows, "labels", 3).select("label", F.round("prior", 6).alias("prior"))


@query("select column_name as scenario from (describe ood_flags) where column_name like 'ood\\_%' escape '\\' and column_name like '%extreme%'")
def scenario_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario flags found by prefix and a part of their name."""
    found = evaluation.scenario_columns(table(spark, sf, "ood_flags").columns, "ood_", "extreme")
    return spark.createDataFrame([(c,) for c in found], "scenario string")


# -- overlap of axes

_PAIRS = [(a, b) for i, a in enumerate(sorted(FLAGS)) for b in sorted(FLAGS)[i + 1 :]]
_OVERLAP = " union all ".join(
    f"select dataset, '{a}' as a, '{b}' as b, count(*) filter (coalesce({a}, false) and coalesce({b}, false)) as both_true, count(*) filter (coalesce({a}, false) and not coalesce({b}, false)) as a_only,"
    f" count(*) filter (not coalesce({a}, false) and coalesce({b}, false)) as b_only from ood_flags group by dataset" for a, b in _PAIRS
)
_JACCARD = f"o as ({_OVERLAP}), j as (select *, both_true / nullif(both_true + a_only + b_only, 0) as jaccard from o)"


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and Jaccard of each two axes in each task, from one pass; NULL where neither holds."""
    return ood.axis_overlap(table(spark, sf, "ood_flags"), "dataset", sorted(FLAGS))


@query(f"with {_JACCARD} select dataset, a, b, both_true, a_only, b_only, round(jaccard, 6) as jaccard from j")
def axis_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).withColumn("jaccard", F.round("jaccard", 6))


@query(f"with {_JACCARD} select dataset, round(avg(jaccard), 6) as mean, round(max(jaccard), 6) as most, count(jaccard) as pairs, count(*) filter (jaccard > 0.5) as high from j group by dataset")
def jaccard_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and greatest Jaccard of the upper triangle of each task, and its pairs above one half."""
    return _overlap(spark, sf).groupBy("dataset").agg(F.round(F.avg("jaccard"), 6).alias("mean"), F.round(F.max("jaccard"), 6).alias("most"), F.count("jaccard").alias("pairs"), F.count_if(F.col("jaccard") > 0.5).alias("high"))


@query(f"with {_JACCARD}, m as (select a, b, avg(jaccard) as mean, count(jaccard) as tasks from j group by all) select a, b, round(mean, 6) as mean, tasks, rank() over (order by round(mean, 12) desc nulls last, a, b) as place from m")
def jaccard_across_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over the tasks that have a value, and the order of the pairs by it."""
    m = _overlap(spark, sf).groupBy("a", "b").agg(F.avg("jaccard").alias("mean"), F.count("jaccard").alias("tasks"))
    o = F.struct(F.col("mean").isNull().alias("none"), (-F.round("mean", 12)).alias("v"))
    return running_totals(m, [o, F.col("a"), F.col("b")], []).select("a", "b", F.round("mean", 6).alias("mean"), "tasks", F.col("position").alias("place"))


@query(f"with {_JACCARD} select dataset, a, b, round(jaccard, 6) as jaccard from j where jaccard > 0.5")
def high_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that hold mostly the same rows, highest first."""
    return _overlap(spark, sf).where("jaccard > 0.5").select("dataset", "a", "b", F.round("jaccard", 6).alias("jaccard")).orderBy(F.desc("jaccard"), "dataset", "a", "b")


# -- pairs of sequences and nested documents


@query("""
with s as (select row_id, upper(regexp_replace(aa_seq, '[^A-Za-z]', '', 'g')) as a, lag(upper(regexp_replace(aa_seq, '[^A-Za-z]', '', 'g'))) over (order by row_id) as b from sample_multilabel),
r as (select *, list_sum(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: (a[i] = b[i])::int)) / greatest(length(a), length(b)) as o from s)
select row_id, round(case when a <> '' and b <> '' and (contains(a, b) or contains(b, a)) then 1 when a = '' or b = '' then 0 else coalesce(o, 0 * length(a) * length(b)) end, 6) as identity from r where b is not null and a is not null""")
def identity_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Equal, held by the other, else equal letters at equal places: each sequence against that of the row before."""
    s = table(spark, sf, "sample_multilabel").select("row_id", F.upper(F.regexp_replace("aa_seq", "[^A-Za-z]", "")).alias("a"))
    placed = running_totals(s, [F.col("row_id")], [])
    before = placed.select((F.col("position") + 1).alias("position"), F.col("a").alias("b"))
    return placed.join(merged(before), "position").where("a is not null and b is not null").select("row_id", F.round(text.identity_cascade(F.col("a"), F.col("b")), 6).alias("identity"))


@query("""
with p as (select p_partkey, p_type as x, p_name as y, case p_partkey % 4 when 0 then p_type when 1 then p_name when 2 then substr(p_type, 2) || 'q' else substr(p_name, 1, 3) || p_type end as w from part),
o as (select *, coalesce(list_sum(list_transform(range(1, least(length(x), length(w)) + 1), lambda i: (x[i] = w[i])::int)), 0) / greatest(length(x), length(w)) as ox, coalesce(list_sum(list_transform(range(1, least(length(y), length(w)) + 1), lambda i: (y[i] = w[i])::int)), 0) / greatest(length(y), length(w)) as oy from p)
select p_partkey, case when x = w then 'first' when y = w then 'second' when length(x) = length(w) and length(y) <> length(w) then 'first_by_length' when length(y) = length(w) and length(x) <> length(w) then 'second_by_length'
  when ox >= oy then 'first_by_likeness' else 'second_by_likeness' end as side from o""")
def side_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Which member of a possibly swapped pair a text is."""
    x, y = F.col("p_type"), F.col("p_name")
    k = F.col("p_partkey") % 4
    w = F.when(k == 0, x).when(k == 1, y).when(k == 2, F.concat(F.expr("substring(p_type, 2)"), F.lit("q"))).otherwise(F.concat(F.substring("p_name", 1, 3), x))
    return table(spark, sf, "part").select("p_partkey", text.side(x, y, w).alias("side"))


@query("""
select p_partkey, 'P' || p_partkey::varchar as pdb_id, case when p_partkey % 4 = 3 then null else p_brand end as method, case p_partkey % 4 when 0 then p_size / 10.0 when 1 then p_size / 20.0 when 2 then p_size / 40.0 end as resolution,
  case when p_partkey % 4 = 0 then 0.25 end as r_free, '2020-01-0' || (p_partkey % 9 + 1)::varchar as deposition_date from part""")
def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested entries whose parts are lists, single objects or missing, flattened with the fallback for the resolution."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    method = F.concat(F.lit('{"method": "'), "p_brand", F.lit('"}'))
    listed = F.concat(F.lit('"exptl": ['), method, F.lit('], "refine": [{"ls_d_res_high": '), (size / 10.0).cast("string"), F.lit(', "ls_R_factor_R_free": 0.25}]'))
    single = F.concat(F.lit('"exptl": '), method, F.lit(', "refine": {"ls_d_res_high": '), (size / 20.0).cast("string"), F.lit("}"))
    em = F.concat(F.lit('"exptl": ['), method, F.lit('], "refine": null, "em_3d_reconstruction": [{"resolution": '), (size / 40.0).cast("string"), F.lit("}]"))
    body = F.when(k == 0, listed).when(k == 1, single).when(k == 2, em).otherwise('"exptl": [], "refine": []')
    doc = F.concat(F.lit('{"rcsb_id": "p'), F.col("p_partkey").cast("string"), F.lit('", "rcsb_accession_info": {"deposit_date": "2020-01-0'), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit('"}, '), body, F.lit("}"))
    flat = table(spark, sf, "part").select("p_partkey", text.entry_metadata(doc).alias("m"))
    return flat.select("p_partkey", "m.pdb_id", "m.method", "m.resolution", "m.r_free", "m.deposition_date")
