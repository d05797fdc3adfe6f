"""Evaluation metrics as grouped aggregations over a long relation (subset, row, class, score, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oodmill.operators.ranked import running_totals


def zero_if_undefined(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def regression(df: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """rmse, mae and pearson of each group; pearson is 0 where undefined."""
    e = F.col(pred) - F.col(truth)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.count("*") < 2, 0.0).otherwise(zero_if_undefined(F.try_divide(F.covar_pop(pred, truth), F.stddev_pop(pred) * F.stddev_pop(truth)))).alias("pearson"),
    )


def ranking(df: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """auroc (tie-aware, NULL for one class) and auprc (average precision over distinct scores, 0 without positives).

    Rows collapse to (group, distinct score) before anything is ordered; running counts come from range partitions.
    """
    cells = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    run = running_totals(cells, [-F.col("_s")], ["pos", "neg"], keys)
    total = cells.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    # each negative below a positive is won, each at the same score half
    won = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    sums = run.groupBy(*keys).agg(F.sum(F.col("pos") * precision).alias("ap"), F.sum(won).alias("u"))
    return total.join(sums, keys).select(
        *keys, F.col("p").alias("positives"), F.col("n").alias("negatives"),
        F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auroc"), F.coalesce(F.try_divide(F.col("ap"), F.col("p").cast("double")), F.lit(0.0)).alias("auprc"),
    )


def binary_f1(df: DataFrame, keys: list[str], score: str, y: str, at: float = 0.5) -> DataFrame:
    said, true = F.col(score) >= at, F.col(y) == 1
    tp, fp, fn = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def argmax_class(scores: Column) -> Column:
    """Index of the greatest score; the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def macro_f1(df: DataFrame, keys: list[str], pred: str, truth: str, classes: int | None = None) -> DataFrame:
    """accuracy and macro_f1 over the classes seen in truth or prediction, and macro_f1_all over all columns."""
    both = df.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("tp")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(pred) == F.col(truth)).cast("int").alias("tp")))).alias("x")).select(*keys, "x.*")
    per = both.groupBy(*keys, "c").agg((2.0 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("f1"), F.sum("tp").alias("tp"), F.sum("t").alias("t"))
    wide = [F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("accuracy")]
    if classes:
        wide.append((F.sum("f1") / F.lit(classes)).alias("macro_f1_all"))
    return per.groupBy(*keys).agg(*wide)


def fmax(df: DataFrame, row: str, score: str, y: str, thresholds: int | str | list[float] = 500, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, precision, recall, f1) of the best threshold, precision and recall averaged over all rows (0 where
    nothing is predicted); the lowest threshold wins ties.

    thresholds: a number of evenly spaced steps from 0.01 to 0.99, a list of them, or "distinct": the distinct scores if
    there are at most 500, else the 500 steps. A score counts for the steps up to its own: counts a (row, last step) are
    taken once and summed from the top, so no row meets all thresholds before aggregation.
    """
    keys = keys or []
    if thresholds == "distinct":
        seen = [r[0] for r in df.select(F.col(score).cast("double")).where(F.col(score).isNotNull()).distinct().limit(501).collect()]
        thresholds = sorted(seen) if len(seen) <= 500 else 500
    if isinstance(thresholds, int):
        width = 0.98 / max(1, thresholds - 1)
        at = lambda step: F.lit(0.01) + step * width
        step = F.least(F.floor((F.col(score) - 0.01) / width + 1e-9).cast("int"), F.lit(thresholds - 1))
        count = thresholds
    else:
        steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
        at = lambda step: F.element_at(steps, step + 1)
        step = F.size(F.filter(steps, lambda t: t <= F.col(score))) - 1
        count = len(thresholds)
    totals = df.groupBy(*keys, F.col(row).alias("row")).agg(F.sum(F.col(y)).alias("truth"))
    cells = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(row).alias("row"), step.alias("step")).agg(F.sum(F.col(y)).alias("tp"), F.count("*").alias("said")).where("step >= 0")
    # the precision of a row changes only at its own steps, as many as it has classes at most
    down = Window.partitionBy(*keys, "row").orderBy(F.desc("step"))
    run = down.rowsBetween(Window.unboundedPreceding, 0)
    spans = cells.select(*keys, "row", F.col("step").alias("top"), F.coalesce(F.lead("step").over(down), F.lit(-1)).alias("below"), F.sum("tp").over(run).alias("tp"), F.sum("said").over(run).alias("said")).join(totals, [*keys, "row"])
    value = [(F.col("tp") / F.col("said")).alias("p"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("truth").cast("double")), F.lit(0.0)).alias("r")]
    # a span adds its value at `top` and takes it away at `below`; sums from the highest step down give each threshold
    ends = spans.select(*keys, "top", "below", *value).select(*keys, F.explode(F.array(F.struct(F.col("top").alias("step"), "p", "r"), F.struct(F.col("below").alias("step"), (-F.col("p")).alias("p"), (-F.col("r")).alias("r")))).alias("e")).select(*keys, "e.*")
    number = totals.groupBy(*keys).agg(F.count("*").alias("rows"))
    grid = number.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("step"))
    summed = grid.join(ends.groupBy(*keys, "step").agg(F.sum("p").alias("p"), F.sum("r").alias("r")), [*keys, "step"], "left").fillna(0.0, ["p", "r"])
    whole = Window.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    curve = summed.select(*keys, at(F.col("step")).alias("threshold"), (F.sum("p").over(whole) / F.col("rows")).alias("precision"), (F.sum("r").over(whole) / F.col("rows")).alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    best = curve.withColumn("f1", f1).groupBy(*keys).agg(F.min(F.struct((-F.round("f1", 12)).alias("o"), "threshold", "precision", "recall", "f1")).alias("b"))
    return best.where("b is not null").select(*keys, "b.threshold", "b.precision", "b.recall", "b.f1")


def label_aupr(df: DataFrame, keys: list[str], label: str, score: str, y: str) -> DataFrame:
    """(keys, micro_aupr, macro_aupr): average precision over all cells, and averaged over the labels that have a positive
    (0 where none has)."""
    micro = ranking(df, keys, score, y).select(*keys, F.col("auprc").alias("micro_aupr"))
    each = ranking(df, [*keys, label], score, y)
    macro = each.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("positives") > 0, F.col("auprc"))), F.lit(0.0)).alias("macro_aupr"))
    return micro.join(macro, keys)


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, spearman): Pearson of average ranks inside each group; NULL below two rows or where a side is constant. Values
    that are not finite are an error."""
    held = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    for c in "ab":
        wrong = F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
        held = held.withColumn(c, F.when(wrong, F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(F.col(c)))
    ranked = held
    for c in "ab":
        run = running_totals(held.groupBy(*keys, c).agg(F.count("*").alias("n")), [F.col(c)], ["n"], keys)
        ranked = ranked.join(run.select(*keys, c, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(f"r{c}")), [*keys, c])
    value = F.when(F.count("*") > 1, F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")))
    return ranked.groupBy(*keys).agg(value.alias("spearman"))


def macro_fmax(df: DataFrame, label: str, score: str, y: str) -> DataFrame:
    """(macro_fmax, classes): the best F of each class over its own distinct scores, averaged over the classes that
    have a positive; 0 classes give NULL."""
    cells = df.groupBy(F.col(label).alias("label"), F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("said"))
    run = running_totals(cells, [-F.col("_s")], ["pos", "said"], ["label"])
    total = cells.groupBy("label").agg(F.sum("pos").alias("p")).where("p > 0")
    best = run.join(total, "label").groupBy("label").agg(F.max(2.0 * F.col("cum_pos") / (F.col("cum_said") + F.col("p"))).alias("f"))
    return best.agg(F.avg("f").alias("macro_fmax"), F.count("*").alias("classes"))


def task_type(df: DataFrame, label: str, order: str, sample: int = 200) -> str:
    """Kind of task, told from the first labels in row order: residual (bracketed lists), multilabel (; between),
    binary (0 and 1 only), single_label (integers of more than two kinds, or text), regression (other numbers)."""
    first = df.where(F.col(label).isNotNull()).orderBy(order).limit(sample).select(F.trim(F.col(label).cast("string")).alias("v"))
    number = F.col("v").try_cast("double")
    r = first.agg(
        F.bool_or(F.col("v").startswith("[")).alias("lists"), F.bool_or(F.col("v").contains(";")).alias("many"), F.bool_and(number.isNotNull()).alias("numeric"),
        F.bool_and(F.coalesce(number == F.floor(number), F.lit(False))).alias("whole"), F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("flags"), F.count_distinct("v").alias("kinds"),
    ).first()
    if r["lists"]:
        return "residual"
    if r["many"]:
        return "multilabel"
    if r["flags"]:
        return "binary"
    if r["numeric"] and not (r["whole"] and r["kinds"] > 2):
        return "regression"
    return "single_label"


def null_errors(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """test with the predictions that know nothing of a row: the train median and the train mean (the positive rate
    of a 0/1 label)."""
    median, mean = train.agg(F.percentile(y, F.lit(0.5)), F.avg(y)).first()
    return test.withColumns({"null_median": F.lit(median), "null_mean": F.lit(mean)})
