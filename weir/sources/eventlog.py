"""Logs of scored events and the archive of host events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(\[.*?\]),\((.*)\),([^,]*)$"


def log_lines(df: DataFrame, point: str = "point", tag: str = "tag", score: str = "score") -> DataFrame:
    return df.select(F.concat(F.col(point), F.lit(",("), F.col(tag), F.lit("),"), F.col(score).cast("string")).alias("value"))


def parse_event_log(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike(LINE)).select(
        F.regexp_extract("value", LINE, 1).alias("point"), F.regexp_extract("value", LINE, 2).alias("tag"),
        F.regexp_extract("value", LINE, 3).alias("score"))


def write_event_log(df: DataFrame, path: str, point: str = "point", tag: str = "tag", score: str = "score") -> None:
    """Append `point,(tag),score` lines."""
    log_lines(df, point, tag, score).write.mode("append").text(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_log(spark.read.text(path))


def write_event_archive(events: DataFrame, path: str) -> None:
    """Append host events, partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_event_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived events with their vector as `features`, ready to train a profile."""
    return spark.read.parquet(path).withColumn("features", F.col("vec"))
