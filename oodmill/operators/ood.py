"""Novelty flags of test rows against a reference split. Flags are tri-state: NULL means not computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ_CUTS = [90, 80, 70, 60, 50, 40, 30]


def best_hits(hits: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(query, best, best_evalue): the best score of each query; hits: query, target, score, evalue."""
    rows = hits.where("query <> target") if exclude_self else hits
    return rows.groupBy("query").agg(F.max("score").alias("best"), F.min("evalue").alias("best_evalue"))


def ladder(best: Column, cuts: list[float], prefix: str) -> list[Column]:
    """One flag a cutoff: the best similarity to the reference lies strictly below it; no hit counts as 0."""
    score = F.coalesce(best, F.lit(0.0))
    return [(score < F.lit(float(c))).alias(f"{prefix}{str(c).replace('.', '_')}") for c in cuts]


def with_best_hits(test: DataFrame, key: str, hits: DataFrame, cuts: list[float], prefix: str = "seq_redundancy_") -> DataFrame:
    """test with the ladder flags and ood_orphan (no row in the hit table)."""
    best = best_hits(hits).withColumnRenamed("query", key)
    joined = test.join(best, key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in test.columns], *ladder(F.col("best"), cuts, prefix), F.col("best").isNull().alias("ood_orphan"))


def code_frequency(rows: DataFrame, codes: str) -> DataFrame:
    """(code, freq): in how many rows of an array column each code stands."""
    return rows.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("freq"))


def code_flags(test: DataFrame, key: str, codes: str, reference: DataFrame, flags: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, flag...): each flag is `all` or `any` of a condition over the reference frequency `freq` of a row's codes.

    Codes unseen in the reference have freq 0; rows without codes are False. The reference is joined by code, so
    neither side needs to fit a task.
    """
    pairs = test.select(key, F.explode(F.array_distinct(codes)).alias("code"))
    seen = pairs.join(reference, "code", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    ways = {"all": F.bool_and, "any": F.bool_or}
    found = seen.groupBy(key).agg(*[ways[how](cond).alias(name) for name, (how, cond) in flags.items()])
    return test.select(key).join(found, key, "left").select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])


def new_pairs(test: DataFrame, reference: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, ood_combinatorial): some unordered pair of a row's codes never stands together in the reference."""

    def pairs(df: DataFrame, *keep: str) -> DataFrame:
        sorted_codes = df.select(*keep, F.array_sort(F.array_distinct(codes)).alias("c"))
        both = F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> struct(x as a, y as b))))")
        return sorted_codes.where("size(c) > 1").select(*keep, F.explode(both).alias("p")).select(*keep, "p.a", "p.b")

    known = pairs(reference).distinct()
    novel = pairs(test, key).join(known, ["a", "b"], "left_anti").select(key).distinct().withColumn("ood_combinatorial", F.lit(True))
    return test.select(key).join(novel, key, "left").select(key, F.coalesce("ood_combinatorial", F.lit(False)).alias("ood_combinatorial"))


def any_flag(flags: list[str]) -> Column:
    """True where any flag is True; NULL counts as False."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{f}`"), F.lit(False)) for f in flags])


def ind(flags: list[str]) -> Column:
    return ~any_flag(flags)


def true_flags(df: DataFrame, flags: list[str], keep: list[str]) -> DataFrame:
    """(keep..., flag): one row for each True flag of a row."""
    held = F.array_compact(F.array(*[F.when(F.col(f"`{f}`"), F.lit(f)) for f in flags]))
    return df.select(*keep, F.explode(held).alias("flag"))


def flag_columns(df: DataFrame) -> list[str]:
    """Flag columns by their prefixes."""
    return [c for c, t in df.dtypes if t == "boolean" and c.lower().startswith(("ood_", "seq_redundancy_", "tm_score_", "tm-score_"))]


def nested_violations(df: DataFrame, chains: list[tuple[str, str]]) -> DataFrame:
    """(inner, outer, violations): rows where the inner flag is True and the outer is False."""
    counts = [F.count_if(F.col(a) & ~F.col(b)).alias(f"v{i}") for i, (a, b) in enumerate(chains)]
    one = df.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("inner_flag"), F.lit(b).alias("outer_flag"), F.col(f"v{i}").alias("violations")) for i, (a, b) in enumerate(chains)])).alias("r")).select("r.*")


def axis_overlap(df: DataFrame, task: str, flags: list[str]) -> DataFrame:
    """(task, a, b, both_true, a_only, b_only, jaccard) of each two flags in each task; jaccard is NULL where neither holds.

    All pair counts are sums of one pass; no row is joined with itself.
    """
    held = df.select(task, *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags])
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    sums = held.groupBy(task).agg(*[F.count_if(f).alias(f) for f in flags], *[F.count_if(F.col(a) & F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("both_true"), (F.col(a) - F.col(f"p{i}")).alias("a_only"), (F.col(b) - F.col(f"p{i}")).alias("b_only")) for i, (a, b) in enumerate(pairs)]
    long = sums.select(task, F.explode(F.array(*cells)).alias("c")).select(task, "c.*")
    return long.withColumn("jaccard", F.try_divide(F.col("both_true").cast("double"), (F.col("both_true") + F.col("a_only") + F.col("b_only")).cast("double")))
