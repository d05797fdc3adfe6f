"""Similarity joins over bit sets and k-mers, spatial joins, clique partition and leakage fixpoints."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oodmill.operators.graph import connected_components
from oodmill.operators.ranked import running_totals
from oodmill.operators.stretches import candidates
from oodmill.session import cut, merged


def kmers(c: Column, k: int) -> Column:
    """The set of k-letter windows of a text; empty if it is shorter."""
    starts = F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(k))))


def tanimoto(shared: Column, a: Column, b: Column) -> Column:
    """shared / (a + b - shared), 0 where the union is empty."""
    return F.coalesce(F.try_divide(shared.cast("double"), (a + b - shared).cast("double")), F.lit(0.0))


def best_reference(queries: DataFrame, reference: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, best): the greatest Tanimoto similarity of a stated query set to any reference row, by an inverted index.

    Only rows that share a bit meet, and shared bits are counted before anything else is looked up. Queries without a
    common bit get 0.
    """
    q = queries.select(F.col(key).alias("q"), F.size(bits).alias("nq"), F.explode(bits).alias("bit"))
    r = reference.select(F.col(key).alias("r"), F.size(bits).alias("nr"), F.explode(bits).alias("bit"))
    shared = q.join(r, "bit").where("q <> r").groupBy("q", "nq", "r", "nr").agg(F.count("*").alias("s"))
    best = shared.groupBy("q").agg(F.max(tanimoto(F.col("s"), F.col("nq"), F.col("nr"))).alias("best"))
    return queries.select(F.col(key).alias("q")).join(best, "q", "left").select(F.col("q").alias(key), F.coalesce("best", F.lit(0.0)).alias("best"))


def prefix_pairs(df: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of sets whose Jaccard similarity reaches `least`, exactly.

    Sets are ordered by global item frequency, rarest first; two sets that reach the threshold share an item in their
    prefixes of n - ceil(least * n) + 1 items, so only prefixes are joined. Sizes must fit too. Survivors are verified.
    """
    sets = cut(df.select(F.col(key).alias("id"), F.array_distinct(items).alias("s")).where(F.size("s") > 0))
    flat = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("item"))
    freq = flat.groupBy("item").agg(F.count("*").alias("f"))
    ranked = flat.join(freq, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("o"))
    prefix = ranked.select("id", "n", F.explode(F.expr(f"slice(o, 1, n - cast(ceil({least} * n - 1e-9) as int) + 1)")).alias("o")).select("id", "n", "o.item")
    left, right = (prefix.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "item") for x in "ab")
    pairs = left.join(right, "item").where(f"a < b and na >= {least} * nb - 1e-9 and nb >= {least} * na - 1e-9").select("a", "b").distinct()
    a, b = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", tanimoto(common, F.size("sa"), F.size("sb")).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least - 1e-12)


def _marks(text: str, k: int, bits: int = 2048) -> tuple[int, bytes]:
    """(distinct windows, a bitmap with the bit of each window's hash set)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.zeros(len(points) - k + 1, np.uint64)
    for i in range(k):
        code = code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(code)]
    flags = np.zeros(bits, np.uint8)
    flags[((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(bits)] = 1
    code.sort()
    return int((code[1:] != code[:-1]).sum()) + 1, np.packbits(flags).tobytes()


def _may_reach(x: list[tuple[int, bytes]], y: list[tuple[int, bytes]], least: float) -> np.ndarray:
    """Whether two sets may have that Jaccard similarity: a bit that one bitmap lacks is a window that one set lacks."""
    nx, ny = (np.array([n for n, _ in side], np.int64) for side in (x, y))
    bx, by = (np.frombuffer(bytearray().join(b for _, b in side), np.uint64).reshape(len(side), -1) for side in (x, y))
    mx, my = np.bitwise_count(bx & ~by).sum(1, dtype=np.int64), np.bitwise_count(by & ~bx).sum(1, dtype=np.int64)
    return np.minimum((nx - mx) / (ny + mx), (ny - my) / (nx + my)) >= least - 1e-12


def window_pairs(df: DataFrame, key: str, text: str, k: int, least: float, run: int = 2) -> DataFrame:
    """(a, b, x, y, jaccard), a < b: all pairs of distinct texts x, y whose sets of k-letter windows reach the Jaccard
    similarity `least`, exactly.

    Such a pair shares 2 * least / (1 + least) of the windows of the text with fewer of them, so candidates meet on stretches
    of windows; texts are fetched for these alone and compared. Nothing that grows with the table is broadcast. NULL texts
    and those shorter than k have no pair.
    """
    texts = cut(df.select(F.col(key).alias("id"), F.col(text).alias("seq")).where(F.length("seq") >= k))
    near = candidates(texts, None, k, 2 * least / (1 + least), run)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: dict[str, tuple[int, bytes]] = {}
        for batch in batches:
            if len(marks) > 100_000:
                marks.clear()
            for s in {*batch["x"], *batch["y"]} - marks.keys():
                marks[s] = _marks(s, k)
            batch = batch[_may_reach([marks[s] for s in batch["x"]], [marks[s] for s in batch["y"]], least)]
            both = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                u, v = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (x, y))
                both.append(len(u & v) / len(u | v))
            yield batch.assign(jaccard=both)[[j >= least - 1e-12 for j in both]]

    of = lambda c, t: merged(texts.select(F.col("id").alias(c), F.col("seq").alias(t)))
    return near.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(verify, "a bigint, b bigint, x string, y string, jaccard double")


def radius_pairs(left: DataFrame, right: DataFrame, key: str, xyz: tuple[str, str, str], radius: float) -> DataFrame:
    """(l, r, distance) of all points of left and right within radius, by a grid of cells of that size.

    Each right point stands in its own cell, each left point asks its 27 neighbours; the distance test is exact.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    x, y, z = xyz
    around = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    near = left.select(F.col(key).alias("l"), *[F.col(c).alias(f"l{c}") for c in xyz], F.explode(around(x)).alias("cx"), around(y).alias("ys"), around(z).alias("zs"))
    near = near.select("*", F.explode("ys").alias("cy")).select("*", F.explode("zs").alias("cz")).drop("ys", "zs")
    held = right.select(F.col(key).alias("r"), *[F.col(c).alias(f"r{c}") for c in xyz], *[cell(c).alias(f"c{a}") for c, a in zip(xyz, "xyz", strict=True)])
    d2 = sum(((F.col(f"l{c}") - F.col(f"r{c}")) * (F.col(f"l{c}") - F.col(f"r{c}")) for c in xyz), F.lit(0.0))
    return near.join(held, ["cx", "cy", "cz"]).where(d2 <= radius * radius).select("l", "r", F.sqrt(d2).alias("distance"))


def clique_partition(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, clique): greedy cliques inside each connected component: the least node left opens a clique, then the
    least node linked to all its members joins, until none does. Components are handled side by side."""
    parts = cut(connected_components(pairs, "a", "b").select(F.col("node").cast("bigint").alias("node"), "component"))
    links = pairs.join(parts.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b")

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, set[int]] = defaultdict(set)
        for a, b in zip(part["a"], part["b"], strict=True):
            of[a].add(b)
            of[b].add(a)
        left, out = set(of), []
        for seed in sorted(of):
            if seed not in left:
                continue
            left.remove(seed)
            options = of[seed] & left
            out.append((seed, seed))
            while options:
                node = min(options)
                out.append((node, seed))
                left.remove(node)
                options = options & of[node]
        return pd.DataFrame(out, columns=[key, "clique"])

    cliques = links.groupBy("component").applyInPandas(greedy, f"`{key}` bigint, clique bigint")
    return df.select(key).join(cliques, key, "left").select(key, F.coalesce("clique", F.col(key)).alias("clique"))


def leakage_fixpoint(df: DataFrame, key: str, split: str, pairs: DataFrame) -> DataFrame:
    """(key, split): val and test rows linked to train, directly or over other rows, move to train.

    A connected component that holds a train row moves as a whole, however long its chains are; that is the state at
    which no row is left to move. Components that do not settle raise. Links to rows that df lacks count for nothing.
    """
    rows = cut(df.select(F.col(key).alias("id"), F.col(split).alias("split")))
    links = pairs.select(*[F.col(c).cast(rows.schema["id"].dataType).alias(c) for c in "ab"])
    for c in "ab":
        links = links.join(rows.where("split is not null").select(F.col("id").alias(c)), c, "left_semi")
    parts = cut(connected_components(cut(links.select("a", "b")), "a", "b"))
    train = rows.where("split = 'train'").select(F.col("id").cast("string").alias("node"))
    leaking = parts.join(train, "node", "left_semi").select("component").distinct()
    moved = parts.join(leaking, "component", "left_semi").select("node", F.lit(True).alias("_m"))
    state = rows.withColumn("node", F.col("id").cast("string")).join(moved, "node", "left")
    return state.select(F.col("id").alias(key), F.when(F.col("_m") & F.col("split").isNotNull(), "train").otherwise(F.col("split")).alias("split"))


def nearest(df: DataFrame, key: str, group: str, distance_to: Column, k: int) -> DataFrame:
    """k rows of least distance a group; ties by key."""
    w = Window.partitionBy(group).orderBy(distance_to, key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def negative_pairs(entities: DataFrame, key: str, known: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(a, b), a <= b: as many unordered pairs of entities as there are entities, none of them known in either direction.

    Each round matches two hashed orders of the entities place by place, so no cross product arises; pairs that are known or
    drawn before fall away, and further rounds fill up what is missing. If unknown pairs are so few that most_rounds do not
    reach the number, an error is raised. An entity may be paired with itself.
    """
    n = entities.count()
    taken = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    drawn = None
    for r in range(most_rounds):
        order = lambda side, r=r: [F.md5(F.concat(F.lit(f"{side}{r}"), F.col(key).cast("string"))), F.col(key)]
        x = running_totals(entities.select(key), order("a"), []).select(F.col(key).alias("x"), "position")
        y = running_totals(entities.select(key), order("b"), []).select(F.col(key).alias("y"), "position")
        new = x.join(merged(y), "position").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(r).alias("r")).dropDuplicates(["a", "b"]).join(merged(taken), ["a", "b"], "left_anti")
        drawn = cut(new if drawn is None else drawn.unionByName(new).groupBy("a", "b").agg(F.min("r").alias("r")))
        if drawn.count() >= n:
            break
    else:
        raise RuntimeError(f"fewer than {n} unknown pairs after {most_rounds} rounds")
    placed = running_totals(drawn, [F.col("r"), F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))), F.col("a"), F.col("b")], [])
    return placed.where(F.col("position") <= n).select("a", "b")
