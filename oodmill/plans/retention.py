"""Matched-control retention over the annotated test rows, beside its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.operators import evaluation, retention
from oodmill.session import cut, shared_dir, table
from oodmill.sources import readers, sinks

DRAWS = 50
SEQ = {30.0: "seq_redundancy_30", 50.0: "seq_redundancy_50", 70.0: "seq_redundancy_70", 90.0: "seq_redundancy_90"}
STR = {0.3: "tm_score_0_3", 0.5: "tm_score_0_5", 0.7: "tm_score_0_7", 0.9: "tm_score_0_9"}
SCENARIOS = ["ood_orphan", "ood_longtail"]


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "ood_flags").where("idr_ratio between 0 and 1")
    rows = cut(
        f.select(
            "row_id", "dataset", F.col("idr_ratio").alias("y"), retention.cutoff_rank(SEQ, 91.0).alias("seq_rank"), retention.cutoff_rank(STR, 1.9).alias("str_rank"),
            retention.pattern(SCENARIOS).alias("scenario"), (F.col("default_flag") == "True").alias("usual"),
        )
    )
    pool = evaluation.reference_pool(rows, F.col("scenario") == "none", F.col("usual"), "seq_rank", "str_rank")
    # predictor: the dataset's mean in the pool; null predictor: the mean of the whole pool
    by = rows.where(pool).groupBy("dataset").agg(F.avg("y").alias("p"))
    overall = rows.where(pool).agg(F.avg("y")).first()[0] or 0.0
    scored = rows.join(F.broadcast(by), "dataset", "left").withColumn("e", F.abs(F.col("y") - F.coalesce("p", F.lit(overall)))).withColumn("e0", F.abs(F.col("y") - F.lit(overall)))
    return retention.matched_retention(scored, "row_id", "dataset", "e", "e0", ["seq_rank", "str_rank", "scenario"], pool, DRAWS)


def matched_control_retention(spark: SparkSession, sf: str) -> DataFrame:
    return _strata(spark, sf).select("seq_rank", "str_rank", "scenario", "n", *[F.round(c, 5).alias(c) for c in ("m", "m0", "b", "b0")], F.round("dpr", 3).alias("dpr"))


def retention_summary(spark: SparkSession, sf: str) -> DataFrame:
    return retention.summary(_strata(spark, sf)).select(F.round("prodpr", 3).alias("prodpr"), F.round("worst", 3).alias("worst"), "strata")


def retention_files(spark: SparkSession, sf: str) -> DataFrame:
    """Strata as CSV and the summary as CSV and JSON, read back from the files."""
    path = f"{shared_dir(spark)}/retention-{uuid4().hex}"
    strata = cut(_strata(spark, sf))
    sinks.csv(strata, f"{path}/strata")
    summary = cut(retention.summary(strata))
    sinks.csv(summary, f"{path}/summary_csv")
    sinks.json_summary(summary, f"{path}/summary")
    rows = readers.csv(spark, f"{path}/strata").agg(F.count("*").alias("rows"), F.count_if(F.col("dpr") != "").alias("with_value"))
    said = spark.read.json(f"{path}/summary").select("strata").join(readers.csv(spark, f"{path}/summary_csv").select(F.col("strata").cast("bigint").alias("strata")), "strata")
    return rows.crossJoin(F.broadcast(said))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "ood_flags").where("idr_ratio between 0 and 1")
    return f.select("row_id", F.col("idr_ratio").alias("y"), retention.cutoff_rank(SEQ, 91.0).alias("seq_rank"), retention.cutoff_rank(STR, 1.9).alias("str_rank"), *SCENARIOS)


def cross_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of rank, rank and pattern with at least 20 rows, but for the one where nothing is shifted."""
    return evaluation.strata(_ranked(spark, sf), "seq_rank", "str_rank", SCENARIOS, "y").where("kind = 'cross'").select("stratum", "n", F.round("mean", 5).alias("mean"))


def fallback_strata(spark: SparkSession, sf: str) -> DataFrame:
    """All strata where a cell needs a fifth of the rows, so that axes fall back to strata of their own."""
    ranked = _ranked(spark, sf)
    return evaluation.strata(ranked, "seq_rank", "str_rank", SCENARIOS, "y", least=max(1, ranked.count() // 5))


def _least(flags: dict[float, str], over: float) -> str:
    return f"coalesce(least({', '.join(f'case when {f} then {c} end' for c, f in flags.items())}), {over})"


_WITH = f"""with f as (select row_id, dataset, idr_ratio as y, {_least(SEQ, 91.0)}::double as seq_rank, {_least(STR, 1.9)}::double as str_rank,
  case when coalesce(ood_orphan, false) and coalesce(ood_longtail, false) then 'ood_orphan+ood_longtail' when ood_orphan then 'ood_orphan' when ood_longtail then 'ood_longtail' else 'none' end as scenario,
  coalesce(default_flag = 'True', false) as usual from ood_flags where idr_ratio between 0 and 1),
cand as (select *, scenario = 'none' and usual as c from f), tops as (select max(seq_rank) as ts, max(str_rank) as tt from cand where c),
tries as (select *, c and seq_rank = ts and str_rank = tt as a1, c and seq_rank = ts as a2, c and str_rank = tt as a3, c as a4, usual as a5 from cand, tops),
sizes as (select count(*) filter (a1) as n1, count(*) filter (a2) as n2, count(*) filter (a3) as n3, count(*) filter (a4) as n4 from tries),
g as (select tries.*, case when n1 >= 20 then a1 when n2 >= 20 then a2 when n3 >= 20 then a3 when n4 >= 20 then a4 else a5 end as in_pool from tries, sizes), o as (select avg(y) as o from g where in_pool), d as (select dataset, avg(y) as p from g where in_pool group by 1),
s as (select g.*, abs(y - coalesce(p, o)) as e, abs(y - o) as e0 from g left join d on d.dataset = g.dataset, o),
r as (select k, dataset, row_number() over w as pos, sum(e) over w as ce, sum(e0) over w as ce0 from s, (select unnest(range(1, {DRAWS + 1})) as k) where in_pool
  window w as (partition by k, dataset order by md5(k::varchar || ':' || row_id::varchar), row_id rows unbounded preceding)),
h as (select dataset, count(*) as have from s where in_pool group by 1), a as (select avg(e) as ae, avg(e0) as ae0 from s where in_pool),
n as (select seq_rank, str_rank, scenario, dataset, count(*) as n, sum(e) as se, sum(e0) as se0 from s where not in_pool group by all),
c as (select n.*, kk.k as k, case when have is null then ae * n.n else ce end as ce, case when have is null then ae0 * n.n else ce0 end as ce0, coalesce(least(n.n, have), n.n) as pos
  from n left join h on h.dataset = n.dataset, a, (select unnest(range(1, {DRAWS + 1})) as k) kk left join r on r.k = kk.k and r.dataset = n.dataset and r.pos = least(n.n, have)),
q as (select seq_rank, str_rank, scenario, k, sum(ce) as ce, sum(ce0) as ce0, sum(pos) as cn, sum(n) as n, sum(se) as se, sum(se0) as se0 from c group by all),
per as (select seq_rank, str_rank, scenario, any_value(n) as n, any_value(se / n) as m, any_value(se0 / n) as m0, avg(ce / cn) as b, avg(ce0 / cn) as b0 from q group by all having any_value(n) >= 20),
dpr as (select *, case when b0 - b > 0.01 * greatest(abs(b), abs(b0), 1e-8) then (m0 - m) / (b0 - b + 1e-12) end as dpr from per)"""

QUERIES = {f.__name__: f for f in (matched_control_retention, retention_summary, retention_files, cross_strata, fallback_strata)}
ORACLES = {
    "matched_control_retention": f"{_WITH} select seq_rank, str_rank, scenario, n, round(m, 5) as m, round(m0, 5) as m0, round(b, 5) as b, round(b0, 5) as b0, round(dpr, 3) as dpr from dpr",
    "retention_summary": f"{_WITH} select round(avg(dpr), 3) as prodpr, round(min(dpr), 3) as worst, count(dpr) as strata from dpr",
    "retention_files": f"{_WITH} select count(*) as rows, count(dpr) as with_value, count(dpr) as strata from dpr",
    "cross_strata": f"""
with f as (select idr_ratio as y, {_least(SEQ, 91.0)}::double as s, {_least(STR, 1.9)}::double as t, coalesce(ood_orphan, false) as o, coalesce(ood_longtail, false) as l from ood_flags where idr_ratio between 0 and 1),
c as (select s, t, o, l, count(*) as n, avg(y) as mean from f group by all), x as (select max(s) as ms, max(t) as mt from f)
select printf('%g', s) || '|' || printf('%g', t) || '|' || case when o and l then 'ood_orphan+ood_longtail' when o then 'ood_orphan' when l then 'ood_longtail' else 'none' end as stratum, n, round(mean, 5) as mean
from c, x where n >= 20 and not (s = ms and t = mt and not o and not l)""",
}
