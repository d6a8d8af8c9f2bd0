"""Session construction and the durable folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "weir", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    On a cluster the master and the shuffle width come from the submit command; AQE coalesces the
    shuffle partitions and splits skewed join partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the source line of every column expression is not worth its cost on plans with hundreds of them
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master or cores:
        n = cores or os.cpu_count() or 4
        builder = (
            builder.master(master or f"local[{n}]")
            .config("spark.sql.shuffle.partitions", str(n))
            .config("spark.driver.memory", os.environ.get("WEIR_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


#: Bytes of an Arrow batch where a row holds a block of vectors.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES, if it is above."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(name))) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make a private one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weir-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
