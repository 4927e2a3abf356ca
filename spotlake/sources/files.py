"""Lines from files, and events to files and displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, source_id: str, policy: str = "Auto", start_us: int = 0, step_us: int = 1_000_000) -> DataFrame:
    """A text file's lines as they would have arrived, `step_us` apart; numbering follows file order within one file."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return rows.where(F.rtrim("value") != "").select(F.lit(source_id).alias("source_id"), F.col("n").alias("seq"), (F.lit(start_us) + F.col("n") * step_us).alias("t_us"), "value", F.lit(policy).alias("originator_policy"))


def latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def json_lines(events: DataFrame) -> DataFrame:
    """One JSON object per spot event."""
    return events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(events: DataFrame, path: str) -> None:
    json_lines(events).write.mode("append").text(path)


def format_freq(hz: Column) -> Column:
    """kHz with one decimal, cut."""
    return F.concat(F.floor(hz / 1000).cast("string"), F.lit("."), F.floor(F.pmod(hz, F.lit(1000)) / 100).cast("string"))


def format_band(band: Column) -> Column:
    return F.when(band == "Unknown", "?").otherwise(F.concat(F.substring(band, 2, 9), F.lit("m")))


def format_age(seconds: Column) -> Column:
    """12s, 5m03s, 2h07m."""
    part = lambda by: F.floor(seconds / by)
    short = F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.format_string("%dm%02ds", part(60), F.pmod(seconds, F.lit(60))))
    return short.otherwise(F.format_string("%dh%02dm", part(3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)))


def format_mode(mode: Column) -> Column:
    return F.when(mode == "Unknown", "?").otherwise(mode)


def truncate(text: Column, most: int) -> Column:
    """The first `most` characters."""
    return F.substring(text, 1, most)
