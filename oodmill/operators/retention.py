"""Retention of performance under shift, against matched controls from a reference pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oodmill.operators.ranked import running_totals
from oodmill.session import cut


def cutoff_rank(flags: dict[float, str], over: float) -> Column:
    """Least cutoff whose flag is True, else `over`; NULL flags count as False."""
    return F.coalesce(F.array_min(F.array_compact(F.array(*[F.when(F.col(f"`{f}`"), F.lit(float(c))) for c, f in flags.items()]))), F.lit(over))


def pattern(flags: list[str]) -> Column:
    """The True flags joined by +, or none."""
    held = F.concat_ws("+", F.array_compact(F.array(*[F.when(F.col(f"`{f}`"), F.lit(f)) for f in flags])))
    return F.when(held == "", "none").otherwise(held)


def matched_retention(
    rows: DataFrame, ident: str, profile: str, error: str, null_error: str, strata: list[str], pool: Column, draws: int = 50, least: int = 20, gap: float = 0.01
) -> DataFrame:
    """One row a stratum outside the pool with at least `least` rows: n, m, m0, b, b0 and dpr, the retained share of
    the advantage over the null predictor (errors, so less is better).

    Controls: for each draw, the pool is put in hashed order inside each profile; a stratum takes as many rows of each
    profile as it has itself, the whole profile where that is smaller, and the whole pool's mean where the pool lacks
    the profile. Means of such prefixes come from running totals of the pool, so no control row is copied for a
    stratum. dpr is NULL where the advantage in the reference (b0 - b; negative where the predictor is worse
    than the null one) is at most `gap` of the greater of both reference errors.
    """
    held = cut(rows.select(F.col(ident).alias("id"), F.col(profile).alias("profile"), F.col(error).alias("e"), F.col(null_error).alias("e0"), *strata, pool.alias("in_pool")))
    reference = held.where("in_pool")
    outside = held.where("not in_pool")
    numbered = reference.select("id", "profile", "e", "e0", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    order = [F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("id").cast("string"))), F.col("id")]
    run = running_totals(numbered, order, ["e", "e0"], ["draw", "profile"]).select("draw", "profile", "position", "cum_e", "cum_e0")
    sizes = reference.groupBy("profile").agg(F.count("*").alias("have"))
    whole = reference.agg(F.avg("e"), F.avg("e0")).first()
    need = outside.groupBy(*strata, "profile").agg(F.count("*").alias("n"), F.sum("e").alias("se"), F.sum("e0").alias("se0"))
    wanted = need.join(sizes, "profile", "left").withColumn("position", F.least("n", "have")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    taken = wanted.join(run, ["draw", "profile", "position"], "left")
    # a profile the pool lacks stands at the mean of the whole pool
    lacking = lambda c, m: F.when(F.col("have").isNull(), F.lit(m) * F.col("n")).otherwise(F.col(c))
    per_draw = taken.groupBy(*strata, "draw").agg(
        F.sum(lacking("cum_e", whole[0])).alias("ce"), F.sum(lacking("cum_e0", whole[1])).alias("ce0"), F.sum(F.coalesce("position", "n")).alias("cn"),
        F.sum("n").alias("n"), F.sum("se").alias("se"), F.sum("se0").alias("se0"),
    )
    per = per_draw.groupBy(*strata).agg(
        F.first("n").alias("n"), F.first(F.col("se") / F.col("n")).alias("m"), F.first(F.col("se0") / F.col("n")).alias("m0"),
        F.avg(F.col("ce") / F.col("cn")).alias("b"), F.avg(F.col("ce0") / F.col("cn")).alias("b0"),
    ).where(F.col("n") >= least)
    scale = F.greatest(F.abs("b"), F.abs("b0"), F.lit(1e-8))
    dpr = (F.col("m0") - F.col("m")) / (F.col("b0") - F.col("b") + 1e-12)
    return per.withColumn("dpr", F.when(F.col("b0") - F.col("b") > gap * scale, dpr))


def summary(per_stratum: DataFrame) -> DataFrame:
    """Unweighted mean and worst of the strata that have a value."""
    return per_stratum.agg(F.avg("dpr").alias("prodpr"), F.min("dpr").alias("worst"), F.count("dpr").alias("strata"))
