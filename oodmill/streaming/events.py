"""Structured Streaming: windows, sessions, deduplication and incremental annotation against a fixed reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """Events from a folder of parquet files; the time is cast so that it can carry a watermark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def known_only(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static semi join."""
    return events.join(dimension.select(key).distinct(), key, "left_semi")


def annotated(samples: DataFrame, reference: DataFrame, key: str, code: str, rare: int = 10) -> DataFrame:
    """New samples with novelty flags against a fixed reference table of code frequencies (code, freq)."""
    joined = samples.join(reference.select(F.col("code").alias(code), "freq"), code, "left")
    return joined.select(*samples.columns, F.col("freq").isNull().alias("ood_new"), F.coalesce(F.col("freq").between(1, rare), F.lit(False)).alias("ood_longtail"))


def running_extremes(events: DataFrame) -> DataFrame:
    """Per user, over all batches so far: events seen and the greatest value; the state is one row a user."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, float("-inf"))
        for batch in batches:
            n += len(batch)
            most = max(most, float(batch["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, most double", "n long, most double", "update", "NoTimeout")
