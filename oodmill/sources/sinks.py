"""Writers: flat files, FASTA, one output a flag, routed rejects, versioned replacement, checked column overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oodmill.operators.ood import true_flags


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_summary(df: DataFrame, path: str, mode: str = "error") -> None:
    """A small aggregate as JSON lines in one file."""
    df.coalesce(1).write.mode(mode).json(path)


def fasta(df: DataFrame, ident: str, sequence: str, path: str, mode: str = "error") -> None:
    """One record an id; of several sequences the least is written. mode="append" adds records."""
    one = df.where(F.col(sequence).isNotNull()).groupBy(ident).agg(F.min(sequence).alias("s"))
    one.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), F.col("s"))).write.mode(mode).text(path)


def by_flag(df: DataFrame, flags: list[str], path: str, mode: str = "error") -> None:
    """One folder a flag with the rows where it is True; every row is read once."""
    keep = [c for c in df.columns if c not in flags]
    true_flags(df, flags, keep).withColumnRenamed("flag", "subset").write.mode(mode).partitionBy("subset").parquet(path)


def routed(df: DataFrame, ok: Column, good: str, bad: str, mode: str = "error") -> None:
    """Rows that pass to one place, all others (NULL included) to another; the input is computed once."""
    held = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).persist()
    try:
        held.where("_ok").drop("_ok").write.mode(mode).parquet(good)
        held.where("not _ok").drop("_ok").write.mode(mode).parquet(bad)
    finally:
        held.unpersist()


def versioned(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old ones; nothing is replaced in place."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def overwritten(old: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """old with some columns replaced; raises unless all others, row by row, are what they were."""
    new = old.withColumns(columns)
    rest = [c for c in old.columns if c not in columns]
    a, b = old.select(*rest), new.select(*rest)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("columns outside the overwrite changed")
    return new


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def structures(residues: DataFrame, file: str, path: str, mode: str = "error") -> None:
    """Residues (file, chain, resseq, icode, name, x, y, z) as fixed-column ATOM records of their CA atoms, one folder a file
    with its records in the order of chain, number and insertion code. A range is selected by filtering before."""
    serial = F.row_number().over(Window.partitionBy(file).orderBy("chain", "resseq", "icode"))
    at = lambda c: F.format_string("%8.3f", F.col(c))
    line = F.concat(
        F.lit("ATOM  "), F.lpad(serial.cast("string"), 5, " "), F.lit("  CA  "), F.lpad("name", 3, " "), F.lit(" "), F.col("chain"), F.lpad(F.col("resseq").cast("string"), 4, " "),
        F.rpad("icode", 1, " "), F.lit("   "), at("x"), at("y"), at("z"), F.lit("  1.00  0.00           C  "),
    )
    numbered = residues.select(F.col(file), "chain", "resseq", "icode", line.alias("value"))
    numbered.repartition(file).sortWithinPartitions(file, "chain", "resseq", "icode").select(file, "value").write.mode(mode).partitionBy(file).text(path)


def lines(df: DataFrame, path: str, *order: str, key: str | None = None, mode: str = "error", compression: str = "none") -> None:
    """A column `value` as text, sorted inside its files; with a key, one folder a key."""
    kept = df.repartition(key) if key else df
    sort = [*([key] if key else []), *order]
    kept = (kept.sortWithinPartitions(*sort) if sort else kept).select(*([key] if key else []), "value")
    writer = kept.write.mode(mode).option("compression", compression)
    (writer.partitionBy(key) if key else writer).text(path)
