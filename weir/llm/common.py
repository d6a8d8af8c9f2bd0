"""Reading, lineage cuts and text columns shared by the operators."""

from __future__ import annotations

import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.plans.bindings import scratch, table  # noqa: F401


#: Spark's setting to remove the shuffle files of a query when it has ended, and not when the driver next collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """The rows as a table in the folder of spark.checkpoint.dir, so that lost executors cost no recomputation. With `clean` the
    shuffle files they came from go once the table is there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, None)
    if clean:
        spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean and before is None:
            spark.conf.unset(CLEAN_UP)
        elif clean:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast of an object of this library. It is written by value, as functions are, so that workers need no copy of the
    library; a task reads it once."""

    def __init__(self, spark: SparkSession, value):
        self.sent, self.own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"sent": self.sent, "own": None}

    @property
    def value(self):
        if self.own is None:
            self.own = cloudpickle.loads(self.sent.value)
        return self.own


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of an Arrow batch. A task holds a few batches of whole texts at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES, if it is above."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(name))) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of ids and hashes (under 100 bytes each) that may be sent to every executor; beyond it a join shuffles.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of narrow rows, with a broadcast hint only if it was counted and found to be small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
