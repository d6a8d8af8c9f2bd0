"""Exact global positions over a totally ordered table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the order of the given columns.

    Rows are range partitioned and sorted once; the sorted table is checkpointed so that the sampled
    range bounds are the same for the two uses below and survive the loss of an executor. Partition
    sizes (one row per partition) give the offset of each partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_mid", _LOCAL_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so the unpartitioned window is small by construction
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_mid", "_offset")
    )
