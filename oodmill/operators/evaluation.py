"""Evaluation by kind of task over subsets, predictors that know nothing, reference pools and strata."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oodmill.functions import arrays, text
from oodmill.operators import metrics
from oodmill.session import cut


def parse_labels(c: Column, kind: str) -> Column:
    """A label text by kind of task: tokens (multilabel), residue labels (residual), a class name (single_label) or a number."""
    if kind == "multilabel":
        return F.coalesce(text.tokens(c, ";,"), F.array().cast("array<string>"))
    if kind == "residual":
        return arrays.parse_ints(c)
    return F.trim(c) if kind == "single_label" else F.trim(c).try_cast("double")


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) of a wide table of metrics."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(cells).alias("m")).select(*keys, "m.*")


def evaluate(df: DataFrame, kind: str, keys: list[str], threshold: float | None = None) -> DataFrame:
    """(keys, metric, value) of the metrics of a kind of task, for all groups of keys at once.

    df has score and y a row (regression, binary), pred and y (single_label), row, label, score and y a class of a row
    (multilabel), or y and, by the number of labels, pred or score a residue (residual; labels below 0 are masked).
    threshold fixes the threshold of multilabel tasks, as found on validation rows; else it is swept.
    """
    if kind == "regression":
        wide = metrics.regression(df, keys, "score", "y").join(metrics.spearman(df, keys, "score", "y"), keys)
        return long_metrics(wide, keys, ["rmse", "mae", "pearson", "spearman"])
    if kind == "binary":
        wide = metrics.ranking(df, keys, "score", "y").join(metrics.binary_f1(df, keys, "score", "y"), keys)
        return long_metrics(wide.withColumnRenamed("auprc", "aupr"), keys, ["auroc", "aupr", "f1"])
    if kind == "multilabel":
        best = metrics.fmax(df, "row", "score", "y", "distinct" if threshold is None else [threshold], keys)
        wide = best.select(*keys, F.col("f1").alias("fmax"), F.col("threshold").alias("best_threshold")).join(metrics.label_aupr(df, keys, "label", "score", "y"), keys)
        return long_metrics(wide, keys, ["fmax", "best_threshold", "micro_aupr", "macro_aupr"])
    if kind == "single_label":
        return long_metrics(metrics.macro_f1(df, keys, "pred", "y"), keys, ["accuracy", "macro_f1"])
    if kind == "residual":
        valid = df.where("y >= 0")
        if len(valid.select("y").distinct().limit(3).collect()) > 2:
            return evaluate(valid, "single_label", keys)
        wide = metrics.ranking(valid, keys, "score", "y").join(metrics.binary_f1(valid, keys, "score", "y"), keys)
        return long_metrics(wide.withColumnRenamed("auprc", "aupr"), keys, ["aupr", "f1"])
    raise ValueError(f"unknown kind of task {kind}")


def evaluate_all(tasks: dict[str, Callable[[], DataFrame]], like: str, spark) -> DataFrame:
    """The results of many tasks in one table (task, columns of `like`, error); a task that fails, when it is planned or when
    it runs, leaves one row with its error and does not touch the others."""
    parts = []
    for name, run in tasks.items():
        try:
            parts.append(cut(run()).select(F.lit(name).alias("task"), "*", F.lit(None).cast("string").alias("error")))
        except Exception as e:  # noqa: BLE001 - whatever fails stays with its task
            empty = spark.createDataFrame([], like)
            said = spark.createDataFrame([(name, type(e).__name__)], "task string, error string")
            parts.append(said.select("task", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema], "error"))
    return reduce(DataFrame.unionByName, parts)


def scenario_columns(columns: Sequence[str], prefix: str = "ood_", containing: str = "", override: Sequence[str] | None = None) -> list[str]:
    """The scenario flags among columns: those asked for (an error if one is missing), else by prefix and part of the name."""
    if override is not None:
        if missing := [c for c in override if c not in columns]:
            raise ValueError(f"missing columns: {missing}")
        return list(override)
    return [c for c in columns if c.lower().startswith(prefix.lower()) and containing.lower() in c.lower()]


def label_prior(train: DataFrame, label: str) -> DataFrame:
    """(label, prior): share of each class among the training rows."""
    return cut(train.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))).withColumn("prior", F.col("n") / F.sum("n").over(_whole())).drop("n")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over one row a class


def residue_prior(train: DataFrame, labels: str, classes: int) -> DataFrame:
    """(label, prior) over the residues of training rows; labels are clipped to the classes, masked ones left out."""
    each = train.select(F.explode(labels).alias("l")).where("l >= 0").select(F.least(F.col("l"), F.lit(classes - 1)).alias("label"))
    return label_prior(each, "label")


def reference_pool(df: DataFrame, no_scenario: Column, default: Column, seq_rank: str, str_rank: str, least: int = 20) -> Column:
    """Condition that holds for the rows of the reference: rows without a scenario among the default ones, of the top
    sequence and structure rank; relaxed to the top sequence rank, the top structure rank, any rank, any scenario, until
    at least `least` rows are left (the last is taken as it is). Where no row is a default one, all count as such; where
    no default row is without a scenario, all default ones are candidates.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    any_default, any_candidate = df.agg(F.bool_or(ok(default)), F.bool_or(ok(no_scenario) & ok(default))).first()
    base = ok(default) if any_default else F.lit(True)
    candidate = ok(no_scenario) & base if any_candidate or not any_default else base
    tops = df.where(candidate).agg(F.max(seq_rank), F.max(str_rank)).first()
    seq, struct = ok(F.col(seq_rank) == F.lit(tops[0])), ok(F.col(str_rank) == F.lit(tops[1]))
    attempts = [candidate & seq & struct, candidate & seq, candidate & struct, candidate, base]
    sizes = df.agg(*[F.count_if(a) for a in attempts]).first()
    return next((a for a, n in zip(attempts, sizes, strict=True) if n >= least), attempts[-1])


@dataclass(frozen=True)
class Cell:
    seq: float
    struct: float
    flags: tuple[bool, ...]
    n: int


def choose_strata(cells: list[Cell], scenarios: list[str], least: int = 20) -> list[tuple[str, str, list[Cell]]]:
    """(kind, name, cells) of the strata made of cells (sequence rank, structure rank, pattern of flags) with their sizes.

    Cross strata are the cells of at least `least` rows, but for the one where nothing is shifted. Axes (ranks, then
    flags) that have no row in a cell of that size fall back to strata of their own: the one with fewest rows left
    claims them first, counted again after each claim; an axis left with too few is dropped.
    """
    top_seq, top_struct = max((c.seq for c in cells), default=0.0), max((c.struct for c in cells), default=0.0)
    used = {c for c in cells if c.n >= least}
    still = {c for c in cells if c.seq == top_seq and c.struct == top_struct and not any(c.flags)}
    name = lambda c: f"{c.seq:g}|{c.struct:g}|{'+'.join(s for s, f in zip(scenarios, c.flags, strict=True) if f) or 'none'}"
    out = [("cross", name(c), [c]) for c in cells if c in used and c not in still]
    axes = [(f"seq {v:g}", {c for c in cells if c.seq == v}) for v in sorted({c.seq for c in cells})]
    axes += [(f"struct {v:g}", {c for c in cells if c.struct == v}) for v in sorted({c.struct for c in cells})]
    axes += [(s, {c for c in cells if c.flags[i]}) for i, s in enumerate(scenarios)]
    pending, claimed = [(a, m) for a, m in axes if not m & used], set()
    while pending:
        left = [sum(c.n for c in m - claimed) for _, m in pending]
        at = min(range(len(pending)), key=lambda i: (left[i], i))
        axis, members = pending.pop(at)
        if left[at] >= least:
            out.append(("fallback", axis, sorted(members - claimed, key=lambda c: (c.seq, c.struct, c.flags))))
            claimed |= members
    return out


def strata(df: DataFrame, seq_rank: str, str_rank: str, scenarios: list[str], measure: str, least: int = 20) -> DataFrame:
    """(kind, stratum, n, mean) of the cross and fallback strata. The choice needs the cells' sizes only (ranks times
    patterns of flags, a bounded number); rows are aggregated once, by cell."""
    flags = [F.coalesce(F.col(s), F.lit(False)).alias(s) for s in scenarios]
    sums = df.groupBy(F.col(seq_rank).alias("seq"), F.col(str_rank).alias("struct"), *flags).agg(F.count("*").alias("n"), F.sum(measure).alias("total"), F.count(measure).alias("known")).collect()
    held = {Cell(float(r["seq"]), float(r["struct"]), tuple(r[s] for s in scenarios), r["n"]): (r["total"] or 0.0, r["known"]) for r in sums}
    rows = []
    for kind, name, cells in choose_strata(list(held), scenarios, least):
        known = sum(held[c][1] for c in cells)
        rows.append((kind, name, sum(c.n for c in cells), sum(held[c][0] for c in cells) / known if known else None))
    return df.sparkSession.createDataFrame(rows, "kind string, stratum string, n bigint, mean double")
