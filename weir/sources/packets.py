"""Captured packets in, feature and pattern points out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.schemas import PACKETS


def read_packets(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    if not streaming:
        return spark.read.schema(PACKETS).parquet(path)
    reader = spark.readStream.schema(PACKETS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def point_line(vec: Column, tag: Column) -> Column:
    """Whole numbers and the tag, separated by comma and space."""
    return F.concat(F.array_join(F.transform(vec, lambda x: x.cast("long").cast("string")), ", "), F.lit(", "), tag)


def write_points(df: DataFrame, path: str, vec: str = "features", tag: str = "tag") -> None:
    """Append feature points as text lines, one part file per task."""
    df.select(point_line(F.col(vec), F.col(tag)).alias("value")).write.mode("append").text(path)


def write_pattern_points(df: DataFrame, path: str, point: str = "point", tag: str = "tag") -> None:
    write_points(df, path, point, tag)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points written by `write_points`: the numbers and the text tag."""
    cells = F.split("value", ", ")
    n = F.size(cells)
    return spark.read.text(path).select(
        F.transform(F.slice(cells, 1, n - 1), lambda x: x.cast("double")).alias("features"),
        F.element_at(cells, -1).alias("tag"))


def stream_write_points(df: DataFrame, path: str, checkpoint: str, vec: str = "features", tag: str = "tag",
                        **trigger) -> StreamingQuery:
    lines = df.select(point_line(F.col(vec), F.col(tag)).alias("value"))
    return (lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
