"""Column-level data quality: range-sorted cumulative curves, exact quantiles, distincts and drift between loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oodmill.session import cut, joined_on, parallelism

BIG = "decimal(38,0)"


def unpivot(df: DataFrame, columns: list[str], load: str, order: str | None = None) -> DataFrame:
    """(load, column_name, value[, order]); values as text, so columns of every type share one relation."""
    keep = [F.col(f"`{load}`").alias("load")] + ([F.col(f"`{order}`").alias("row")] if order else [])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(*keep, pairs.alias("cell")).select(*[k for k in (["load"] + (["row"] if order else []))], "cell.*")


def value_curves(cells: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """cells with cum_<w> of each weight and rank: running sums along the sorted values of each group of keys, without a
    window over a whole group.

    cells: one row a (keys, value). The rows are range-partitioned by (keys, value); each partition sums its rows a
    group, the prefix of these sums over partitions (one row a partition and group) is joined back, and a running sum
    inside the partition completes the curve. A group of any size is thus spread over tasks.
    """
    ranged = cut(cells.repartitionByRange(parallelism(cells.sparkSession), *keys, value).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_p").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights], F.count("*").alias("_d"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_0{c}") for c in [*[f"_s_{w}" for w in weights], "_d"]])
    inside = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    curve = ranged.select("*", *[F.sum(w).over(inside).alias(f"_c_{w}") for w in weights], F.count("*").over(inside).alias("_r"))
    return joined_on(curve, offsets, [*keys, "_p"]).select(
        *cells.columns, *[(F.col(f"_c_{w}") + F.col(f"_0_s_{w}")).alias(f"cum_{w}") for w in weights], (F.col("_r") + F.col("_0_d")).alias("rank")
    )


def load_steps(df: DataFrame, load: str, feed: str) -> DataFrame:
    """(feed, load, prev, next): each load with its neighbours in its feed; NULL where there is none."""
    seen = df.select(F.col(f"`{feed}`").alias("feed"), F.col(f"`{load}`").alias("load")).where("load is not null").distinct()
    w = Window.partitionBy("feed").orderBy("load")
    return seen.select("feed", "load", F.lag("load").over(w).alias("prev"), F.lead("load").over(w).alias("next"))


def merged_curves(cells: DataFrame, steps: DataFrame, points: list[str]) -> DataFrame:
    """Of each load and column the cumulative counts of its values and of those of the load before, along one sorted axis.

    cells: feed, load, column_name and the columns of `points`, one row a cell. Gives (feed, load, column_name, point,
    n1, n2, cum_n1, cum_n2): counts in the load before and in the load itself, and their running sums. Each cell counts
    for its load and the next one in the same aggregation, so cells are shuffled once, combined, and sorted once.
    """
    near = steps.select("feed", "load", "next")
    joined = joined_on(cells, near, ["feed", "load"])
    one, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ahead = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("load"), one.alias("n1"), no.alias("n2")))
    sides = F.array_compact(F.array(F.struct(F.col("load").alias("load"), no.alias("n1"), one.alias("n2")), ahead))
    counted = joined.select("feed", F.explode(sides).alias("s"), "column_name", *points).groupBy("feed", "s.load", "column_name", *points).agg(F.sum("s.n1").alias("n1"), F.sum("s.n2").alias("n2"))
    keyed = counted.select("feed", "load", "column_name", F.struct(*points).alias("point"), "n1", "n2")
    return value_curves(keyed, ["feed", "load", "column_name"], "point", ["n1", "n2"])


def quality_issues(
    df: DataFrame, rules: dict[str, str], load: str, feed: str, row: str, null_shift: float = 0.10, value_shift: float = 0.25
) -> DataFrame:
    """(load_id, column_name, issue, row_id): malformed values by row, and loads that left the one before.

    rules: a whole-value pattern a column. A value is missing if NULL or of length 0. null_shift: the share of missing
    values differs by more than the threshold; value_shift: the total variation between the valid values exceeds it
    (no case where either load has no valid value). Rows without load are checked for patterns only; an empty table
    gives no rows; repeated rows count as rows. Comparisons are between exact integers.
    """
    # bound names first: the table may have columns called load, value, n or the like
    bare = df.select(F.col(f"`{load}`").alias("load"), F.col(f"`{feed}`").alias("feed"), F.col(f"`{row}`").alias("row"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(rules)])
    cells = bare.select(
        "load", "feed", "row",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("value"), F.col(f"c{i}").rlike(rf"\A(?:{rule})\z").alias("fits")) for i, (c, rule) in enumerate(rules.items())])).alias("cell"),
    ).select("load", "feed", "row", "cell.*")
    missing = F.col("value").isNull() | (F.length("value") == 0)
    bad = cells.where(~missing & ~F.col("fits")).select("load", "column_name", F.lit("pattern").alias("issue"), "row")
    state = F.when(missing, 0).when(F.col("fits"), 2).otherwise(1)
    staged = cells.select("feed", "load", "column_name", state.alias("state"), F.when(state == 2, F.col("value")).alias("value"))
    steps = load_steps(bare, "load", "feed")
    # missing values come first on the axis, malformed ones next, valid ones last: the curves give all counts
    curve = cut(merged_curves(staged, steps, ["state", "value"])).where(F.col("load").isNotNull())
    part = F.col("point.state")
    upto = lambda w, s: F.coalesce(F.max(F.when(part <= s, F.col(f"cum_{w}"))), F.lit(0)).cast(BIG)
    ends = curve.groupBy("feed", "load", "column_name").agg(*[upto(f"n{i}", s).alias(f"{name}{i}") for i in (1, 2) for s, name in ((0, "m"), (1, "off"), (2, "rows"))])
    ends = cut(ends.where("rows1 > 0").selectExpr("*", "rows1 - off1 as v1", "rows2 - off2 as v2"))
    scaled = round(null_shift * 1_000_000)
    nulls = ends.where(F.expr(f"abs(m2 * rows1 - m1 * rows2) * 1000000 > {scaled} * rows2 * rows1")).select("load", "column_name", F.lit("null_shift").alias("issue"), F.lit(0).cast("bigint").alias("row"))
    keys = ["feed", "load", "column_name"]
    # twice the distance: how far the difference of the two curves moves in all, from one valid value to the next
    moved = (
        joined_on(curve.where(part == 2), ends, keys)
        .groupBy(*keys, "v1", "v2")
        .agg(F.sum(F.expr("abs(cast(n1 * v2 - n2 * v1 as decimal(38,0)))")).alias("tv2"))
    )
    values = moved.where(F.expr(f"v1 > 0 and v2 > 0 and tv2 * 1000000 > {2 * round(value_shift * 1_000_000)} * v1 * v2")).select(
        "load", "column_name", F.lit("value_shift").alias("issue"), F.lit(0).cast("bigint").alias("row")
    )
    return bad.unionByName(nulls).unionByName(values).select(F.col("load").alias("load_id"), "column_name", "issue", F.col("row").alias("row_id"))


def column_profile(df: DataFrame, load: str, feed: str, numeric: list[str], other: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row a (load, column): rows, nulls, exact distinct count, least and greatest value, exact quantiles
    (nearest rank, numeric columns only) and the exact Kolmogorov-Smirnov distance to the load before (NULL for a
    first load, or where either load has no value). NaN counts as null in numeric columns; rows without load are left
    out. All of it is read off one merged curve.
    """
    cast = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"n{i}") for i, c in enumerate(numeric)]
    bare = df.select(F.col(f"`{load}`").alias("load"), F.col(f"`{feed}`").alias("feed"), *cast, *[F.col(f"`{c}`").cast("string").alias(f"s{i}") for i, c in enumerate(other)])
    nothing = F.lit(None)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("num"), nothing.cast("string").alias("text")) for i, c in enumerate(numeric)]
    structs += [F.struct(F.lit(c).alias("column_name"), nothing.cast("double").alias("num"), F.col(f"s{i}").alias("text")) for i, c in enumerate(other)]
    cells = bare.select("load", "feed", F.explode(F.array(*structs)).alias("cell")).select("load", "feed", "cell.*")
    # nulls come first on the axis; numbers order as numbers, texts as texts
    null = F.col("num").isNull() & F.col("text").isNull()
    curve = merged_curves(cells.withColumn("held", (~null).cast("int")), load_steps(bare, "load", "feed"), ["held", "num", "text"])
    keys = ["feed", "load", "column_name"]
    curve = cut(curve.select(*keys, "point.*", "n1", "n2", "cum_n1", "cum_n2"))
    nulls = lambda w: F.coalesce(F.max(F.when(F.col("held") == 0, F.col(w))), F.lit(0))
    ends = curve.groupBy(*keys).agg(
        F.max("cum_n2").alias("rows"), nulls("n2").alias("nulls"), (F.max("cum_n1") - nulls("n1")).alias("v1"), nulls("n1").alias("nulls1"),
    ).withColumn("v2", F.col("rows") - F.col("nulls"))
    ends = cut(ends.where("rows > 0"))
    held = joined_on(curve.where("held = 1"), ends, keys)
    own = lambda c: F.when(F.col("n2") > 0, F.col(c))
    at = [F.min(F.when((F.col("n2") > 0) & (F.col("cum_n2") - F.col("nulls") >= F.ceil(F.lit(q) * F.col("v2"))), F.col("num"))).alias(f"q{round(q * 100):02d}") for q in quantiles]
    apart = F.max(F.abs(F.expr("cast(cum_n1 - nulls1 as decimal(38,0)) * v2 - cast(cum_n2 - nulls as decimal(38,0)) * v1")))
    ks = F.when((F.first("v1") > 0) & (F.first("v2") > 0), F.round(apart.cast("double") / (F.first("v1").cast("double") * F.first("v2").cast("double")), 6))
    stats = held.groupBy(*keys).agg(
        F.count_if(F.col("n2") > 0).alias("distinct_values"), F.min(own("num")).alias("min_num"), F.max(own("num")).alias("max_num"),
        F.min(own("text")).alias("min_text"), F.max(own("text")).alias("max_text"), *at, ks.alias("ks"),
    )
    return joined_on(ends, stats, keys, "left").select(*keys, "rows", "nulls", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), *stats.columns[4:])
