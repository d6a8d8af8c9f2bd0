"""Labelled feature vectors in CSV files, and the model folder that holds them by tag."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.vectors import filter_width

TAGS = ("normal", "anomalous")
# Lines of a file keep their order in (source, block, row_id): a split of a file is read in order.
LINE_ORDER = ("source", "block", "row_id")


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(list(paths))
        .select("value", F.monotonically_increasing_id().alias("row_id"),
                F.col("_metadata.file_block_start").alias("block"),
                F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    )


def _source_name(path: Column) -> Column:
    """File name, or the folder's name where the sample was written as a folder of part files."""
    part = F.element_at(F.split(path, "/"), -1)
    folder = F.element_at(F.split(path, "/"), -2)
    return F.url_decode(F.when(folder.endswith(".csv"), folder).otherwise(part))


def _features(value: Column) -> Column:
    """All comma-separated values but the last as doubles."""
    cells = F.split(value, ",")
    return F.transform(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: F.trim(x).cast("double"))


def read_feature_csv(spark: SparkSession, *paths: str) -> DataFrame:
    rows = _lines(spark, *paths).where(F.trim("value") != "")
    return rows.select("row_id", _features(F.col("value")).alias("features"),
                       _source_name(F.col("path")).alias("source"), "block")


def load_tagged(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return read_feature_csv(spark, path).withColumn("label", F.lit(tag))


def load_samples(spark: SparkSession, model_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows (normal, P) and test rows (normal, P and anomalous, N).

    Normal rows are as wide as the widest row of their file; anomalous rows are as wide as that of the last
    normal file by name.
    """
    normal = load_tagged(spark, os.path.join(model_dir, TAGS[0]), "P")
    train = filter_width(normal)
    test = train
    if _has_files(spark, os.path.join(model_dir, TAGS[1])):
        last = normal.groupBy("source").agg(F.max(F.size("features")).alias("w")).agg(F.max_by("w", "source"))
        odd = load_tagged(spark, os.path.join(model_dir, TAGS[1]), "N")
        odd = odd.withColumn("_w", last.scalar()).where(F.size("features") == F.col("_w")).drop("_w")
        test = train.unionByName(odd)
    return train, test


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def import_samples(df: DataFrame, model_dir: str, tag: str, name: str) -> str:
    """Write vectors and their tag under the model folder; an existing sample of the name is refused."""
    path = os.path.join(model_dir, tag, name if name.endswith(".csv") else f"{name}.csv")
    label = F.col("label") if "label" in df.columns else F.lit(tag)
    line = F.concat_ws(", ", F.array_join(F.col("features").cast("array<string>"), ", "), label)
    # part files keep the suffix the readers look for
    df.select(line.alias("value")).write.mode("errorifexists").option("lineSep", "\n").format("csv").option(
        "quote", "").option("sep", "\u0001").save(path)
    return path


def model_catalog(spark: SparkSession, model_dir: str, tags: Sequence[str] = TAGS) -> DataFrame:
    """Rows and time of last change of every sample, per tag."""
    out = None
    for tag in tags:
        path = os.path.join(model_dir, tag)
        if not _has_files(spark, path):
            continue
        part = _lines(spark, path).groupBy(_source_name(F.col("path")).alias("name")).agg(
            F.count(F.lit(1)).alias("size"), F.max("modified").alias("modified")).withColumn("tag", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "name string, size long, modified timestamp, tag string")
    return out


def read_raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as arrays of strings; rows may differ in width, quoted cells may hold commas."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col("value")), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return spark.read.text(path).select(plain.alias("cells"))
