"""Contiguous shards of nearly equal bytes, from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import saved, width


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the rows in the order of their ids where the running size passes the multiples of total / shards.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard). A row's size is its text's UTF-8 bytes (a null has none)
    plus 1; its shard follows from the bytes before it, so that shard sizes differ by less than two rows. `slot` counts from 0
    within a shard. Null ids come first; rows of one id, however many, are told apart by their place in the input and may lie
    in two shards; an empty table gives no rows; other columns are not read. Only one row per partition is summed in one
    place.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_at"))
    rows = saved(rows.repartitionByRange(width(docs.sparkSession), "_id", "_at").withColumn("_part", F.spark_partition_id()),
                 "sizes")
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
                          F.sum("_bytes").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_id", "_at")
    placed = (
        rows.withColumn("_sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside)).join(bases, "_part")
        .select("_id", "size", "text_crc32", (F.col("_rows_before") + F.col("_row") - 1).alias("_row"),
                F.expr(f"cast(least({shards - 1}, (_bytes_before + _sum - size) * {shards} div _total) as int)").alias("shard"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
