"""Configuration files as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(lines: DataFrame) -> DataFrame:
    """`key : value` lines; lines without exactly one colon are left out."""
    return (lines.withColumn("_p", F.split(F.trim("value"), ":")).where(F.size("_p") == 2)
            .select(F.trim(F.col("_p")[0]).alias("key"), F.trim(F.col("_p")[1]).alias("value")))


def parse_settings(lines: DataFrame) -> DataFrame:
    return _pairs(lines)


def parse_service_ports(lines: DataFrame) -> DataFrame:
    """service, port; entries that are no whole number are left out, and so are services without any."""
    return (_pairs(lines).select(F.col("key").alias("service"), F.explode(F.split("value", ",")).alias("_t"))
            .select("service", F.trim("_t").try_cast("int").alias("port")).where(F.col("port").isNotNull()))


def parse_nameservers(lines: DataFrame) -> DataFrame:
    """Addresses of the nameserver lines; blank lines and comments are skipped, a line may name several."""
    body = F.regexp_replace("value", r"^[ \f\t\x0B]+", "")
    return (lines.where(body.startswith("nameserver"))
            .select(F.explode(F.split(F.trim(F.regexp_replace(body, "^nameserver", "")), r"\s+")).alias("address"))
            .where(F.col("address") != ""))


def ip_number(text):
    """32-bit number of a dotted quad, null for other text."""
    p = F.split(text, r"\.")
    octets = [F.try_element_at(p, F.lit(i + 1)).try_cast("long") for i in range(4)]
    good = (F.size(p) == 4)
    for o in octets:
        good = good & o.between(0, 255)
    return F.when(good, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return parse_settings(spark.read.text(path))


def read_service_ports(spark: SparkSession, path: str) -> DataFrame:
    return parse_service_ports(spark.read.text(path))


def read_nameservers(spark: SparkSession, path: str) -> DataFrame:
    return parse_nameservers(spark.read.text(path))
