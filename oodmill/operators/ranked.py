"""Positions and running totals over ordered relations, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oodmill.session import cut, merged, parallelism


def running_totals(df: DataFrame, order: list[Column], sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with position (1-based) and cum_<s> of each of sums along the order, within keys if given.

    The order must be total. Rows are range-partitioned by (keys, order); every partition sums its own rows, the sums
    of the partitions before (one row a partition and key) are added, so any number of rows may share a key.
    """
    keys = keys or []
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    sort = [*keys, *names]
    ranged = cut(keyed.repartitionByRange(parallelism(df.sparkSession), *sort).withColumn("_p", F.spark_partition_id()))
    own = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(
        *keys, "_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_s_{s}" for s in sums])]
    )
    inside = Window.partitionBy("_p", *keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*names)).alias("_r"), *[F.sum(s).over(inside).alias(f"_c_{s}") for s in sums])
    placed = local.join(F.broadcast(offsets) if not keys else merged(offsets), [*keys, "_p"])
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_r") + F.col("_b_n")).alias("position"),
        *[(F.col(f"_c_{s}") + F.col(f"_b_s_{s}")).alias(f"cum_{s}") for s in sums],
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; the minimum is combined before its shuffle, so a hot group
    sends one row a task. Each entry of order must be ascending as given; wrap NULLs with nulls_last."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], row.alias("row"))).alias("_b"))
    return best.select("_b.row.*")


def nulls_last(c: Column) -> Column:
    """Ascending order key with NULLs after every value."""
    return F.struct(c.isNull().alias("none"), c.alias("v"))


def descending(c: Column) -> Column:
    """Order key of a number, largest first, NULLs last."""
    return F.struct(c.isNull().alias("none"), (-c).alias("v"))


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """(value, n, avg_rank) of each distinct value: the mean position of its ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    run = running_totals(counts, [F.col("value")], ["n"])
    return run.select("value", "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"))


def share_split(df: DataFrame, order: list[Column], train: float, val: float, out: str = "split") -> DataFrame:
    """Positional split along the order: the first floor(n * train) rows to train, up to floor(n * (train + val)) to
    val, the rest to test. The ratio is summed in double, as written."""
    n = df.count()
    return running_totals(df, order, []).withColumn(
        out, F.when(F.col("position") <= int(n * train), "train").when(F.col("position") <= int(n * (train + val)), "val").otherwise("test")
    )


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Quantile with linear interpolation over all rows; values are counted first and placed by range partitions, so no task
    holds all of them. NULL values are left out; None where there is no other."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = cut(running_totals(counts, [F.col("v")], ["n"]))
    total = run.agg(F.max("cum_n")).first()[0]
    if not total:
        return None
    at = q * (total - 1)
    low, high = run.agg(F.min(F.when(F.col("cum_n") > int(at), F.col("v"))), F.min(F.when(F.col("cum_n") > min(total - 1, int(at) + 1), F.col("v")))).first()
    return low + (high - low) * (at - int(at))
