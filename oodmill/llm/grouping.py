"""Splits that keep tied records together: components, label vectors, grouped iterative stratification."""

from __future__ import annotations

from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oodmill.operators.graph import connected_components
from oodmill.operators.ranked import running_totals
from oodmill.session import cut, merged


def tied_groups(df: DataFrame, row: str, ties: dict[str, Column]) -> DataFrame:
    """(row_id, component[, one column a tie]): rows sharing the value of any tie, directly or through other rows.

    NULL values tie nothing; a row without any value is its own group, and its component is NULL. Links run between
    values, not rows: rows with equal values collapse before the first shuffle, however many there are. Values that
    are whole numbers stay such, which makes the rounds of contraction cheapest; texts work as well, as long as all
    ties are of one kind. Repeated rows keep their place. An empty table gives an empty result.
    """
    rows = cut(df.select(F.col(f"`{row}`").alias("row_id"), *[v.alias(f"t{i}") for i, v in enumerate(ties.values())]))
    names = [f"t{i}" for i in range(len(ties))]
    whole = all(rows.schema[t].dataType.simpleString() in ("int", "bigint") for t in names)
    # a node is a value and its tie, in one number or text
    node = [F.col(t).cast("bigint") * len(names) + i if whole else F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(t))) for i, t in enumerate(names)]
    anchor = F.coalesce(*node)
    links = reduce(DataFrame.union, [rows.select(anchor.alias("u"), n.alias("v")) for n in node]).where("u is not null and v is not null").distinct()
    parts = connected_components(links)
    keyed = rows.withColumn("node", anchor).join(merged(parts), "node", "left").drop("node")
    return keyed.select("row_id", "component", *[F.col(t).alias(name) for t, name in zip(names, ties, strict=True)])


def _levelled(need: dict[str, float], count: int, each: float) -> dict[str, int]:
    """How many of `count` equal groups each split gets if one after another goes to the split that needs most.

    Giving always to the neediest levels the needs, so all but the last few are known at once: the common level to which
    they sink. The last ones are given one by one.
    """
    order = sorted(need, key=lambda s: (-need[s], s))
    level = next(
        x for i in range(1, len(order) + 1)
        for x in [(sum(need[s] for s in order[:i]) - count * each) / i]
        if i == len(order) or x >= need[order[i]]
    )
    given = {s: max(0, floor((need[s] - level) / each)) for s in order}
    left = {s: need[s] - given[s] * each for s in order}
    while sum(given.values()) > count:
        most = min((s for s in order if given[s]), key=lambda s: (left[s], s))
        given[most] -= 1
        left[most] += each
    for _ in range(count - sum(given.values())):
        most = max(order, key=lambda s: (left[s], s))
        given[most] += 1
        left[most] -= each
    return given


def stratified_group_split(rows: DataFrame, group: str, labels: dict[str, Column], shares: dict[str, float], steps: int = 8) -> DataFrame:
    """(group, size, split): whole groups given to splits so that sizes and labels keep the wanted shares.

    Grouped iterative stratification. Groups get label vectors (the counts of each label and of rows). The label with
    the fewest rows outstanding comes first, counted again after each label; its groups, those with most rows of it
    first, go one after another to the split that needs this label most. Groups without any label come last, by rows.

    Groups alike (same label in turn, counts of it and of rows within a `steps`-th of a doubling) are one cell and are
    counted with their mean vector, so the driver holds one row a cell: at most labels x the square of steps x the
    doublings of the largest group, whatever the number of groups. How many groups of a cell a split gets follows in closed form from the rule
    above; which ones, from their place in hashed order, found by running totals. Large groups are alone in their
    cells, so they are placed one by one, exactly. This is the only path, for groups and tables of any size.

    At most 16 labels (the patterns of labels present are counted on the driver). Rows with NULL group are left out: give
    them keys of their own. An empty table gives no row.
    """
    if len(labels) > 16:
        raise ValueError("at most 16 labels")
    counted = [F.coalesce(F.sum(v.cast("int")), F.lit(0)).alias(f"l{i}") for i, v in enumerate(labels.values())]
    names = [f"l{i}" for i in range(len(labels))]
    vectors = rows.where(F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").alias("group")).agg(F.count("*").alias("size"), *counted)
    present = reduce(lambda acc, c: acc + c, [F.when(F.col(n) > 0, 1 << i).otherwise(0) for i, n in enumerate(names)], F.lit(0))
    vectors = cut(vectors.withColumn("present", present))
    patterns = vectors.groupBy("present").agg(*[F.sum(n).alias(n) for n in ["size", *names]]).collect()
    order: list[str] = []
    while True:
        rest = [p for p in patterns if not any(p["present"] >> names.index(n) & 1 for n in order)]
        left = {n: sum(p[n] for p in rest) for n in names if n not in order}
        left = {n: c for n, c in left.items() if c}
        if not left:
            break
        order.append(min(left, key=lambda n: (left[n], n)))
    turn = reduce(lambda acc, n: acc.when(F.col(n) > 0, F.lit(order.index(n))), order[1:], F.when(F.col(order[0]) > 0, F.lit(0))) if order else F.lit(None)
    placed = vectors.withColumn("turn", F.coalesce(turn.cast("int"), F.lit(len(order))))
    own = reduce(lambda acc, i: acc.when(F.col("turn") == i, F.col(order[i])), range(len(order)), F.when(F.col("turn") == len(order), F.col("size")))
    step = lambda c: F.floor(F.log2(c.cast("double")) * steps).cast("int")
    placed = cut(placed.withColumn("cell", step(own)).withColumn("cell2", step(F.col("size"))))
    keys = ["turn", "cell", "cell2"]
    cells = placed.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(n).cast("double").alias(n) for n in ["size", *names]]).collect()
    need = {s: {n: float(sum(p[n] for p in patterns)) * w for n in ["size", *names]} for s, w in shares.items()}
    bounds: list[tuple[int, int, int, str, int, int]] = []
    for c in sorted(cells, key=lambda c: (c["turn"], -c["cell"], -c["cell2"])):
        key = order[c["turn"]] if c["turn"] < len(order) else "size"
        # equal needs of the label are decided by the rows needed: a share of them far below one row
        want = {s: need[s][key] + 1e-9 * need[s]["size"] for s in shares}
        low = 0
        for s, k in _levelled(want, c["n"], c[key] / c["n"]).items():
            if k:
                bounds.append((*(c[x] for x in keys), s, low, low + k))
                low += k
            for n in ["size", *names]:
                need[s][n] -= c[n] / c["n"] * k
    given = rows.sparkSession.createDataFrame(bounds, "turn int, cell int, cell2 int, split string, low bigint, high bigint")
    ordered = running_totals(placed.select("group", "size", *keys), [F.xxhash64("group"), F.col("group")], [], keys)
    # one row a cell and split: bounded as the cells are
    return ordered.join(F.broadcast(given), keys).where("position > low and position <= high").select("group", "size", "split")
