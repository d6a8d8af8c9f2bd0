"""Enrichment of packets from dimension tables. A missing table means that nothing matches.

The joins carry no hints: Catalyst broadcasts a dimension table whose size is below its threshold and
otherwise shuffles, where AQE splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Server pattern codes (fixed values).
SERVER_SYS_CONF, SERVER_BLACK, SERVER_UNKNOWN = 0, 1, 2
# Remote host classes (fixed values).
HOST_LOCAL, HOST_REGULAR, HOST_NEW, HOST_PERSISTENT = 0, 2, 5, 6


def _mark(df: DataFrame, keys: DataFrame | None, key: str, column: str, name: str) -> DataFrame:
    """Add a flag: the value of `column` is among `keys`."""
    if keys is None:
        return df.withColumn(name, F.lit(False))
    known = keys.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return (df.join(known, F.col(column) == F.col("_k"), "left")
            .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit"))


def classify_server(df: DataFrame, nameservers: DataFrame | None = None, blacklist: DataFrame | None = None,
                    scores: DataFrame | None = None, remote: str = "server_ip") -> DataFrame:
    """Add `dst_code` (blacklisted before configured before unknown) and `dst_range` (the server's score)."""
    df = _mark(_mark(df, nameservers, "address", remote, "_conf"), blacklist, "address", remote, "_black")
    code = F.when(F.col("_black"), SERVER_BLACK).when(F.col("_conf"), SERVER_SYS_CONF).otherwise(SERVER_UNKNOWN)
    df = df.withColumn("dst_code", code).drop("_conf", "_black")
    if scores is None:
        return df.withColumn("dst_range", F.lit(0))
    table = scores.groupBy(F.col("address").alias("_k")).agg(F.max("score").cast("int").alias("_s"))
    return (df.join(table, F.col(remote) == F.col("_k"), "left")
            .withColumn("dst_range", F.coalesce("_s", F.lit(0))).drop("_k", "_s"))


def flag_spoofed(df: DataFrame, local_addrs: DataFrame | None = None, client: str = "client_ip") -> DataFrame:
    """Add `spoofed`: an outgoing packet whose source is not a local address."""
    if local_addrs is None:
        return df.withColumn("spoofed", F.lit(False))
    df = _mark(df, local_addrs, "address", client, "_local")
    return df.withColumn("spoofed", (F.col("direction") == "OUT") & ~F.col("_local")).drop("_local")


def service_port() -> Column:
    return F.when(F.col("direction") == "IN", F.col("src_port")).otherwise(F.col("dst_port"))


def label_service(df: DataFrame, service_ports: DataFrame) -> DataFrame:
    """Add the service name of the packet's service port, null when none is listed."""
    names = service_ports.groupBy(F.col("port").alias("_k")).agg(F.min("service").alias("service"))
    return df.join(names, service_port() == F.col("_k"), "left").drop("_k")


def filter_service(packets: DataFrame, iface: str | None, ports: list[int]) -> DataFrame:
    """Packets of one interface whose service port is listed."""
    if not ports or any(not isinstance(p, int) or p <= 0 for p in ports):
        raise ValueError("ports must be positive whole numbers")
    kept = packets.where(service_port().isin(*ports))
    return kept if iface is None else kept.where(F.col("iface") == iface)


def host_reputation(df: DataFrame, history: DataFrame | None = None, host: str = "foreign_address") -> DataFrame:
    """Add the class of the remote host, REGULAR unless the history table says otherwise."""
    if history is None:
        return df.withColumn("reputation", F.lit(HOST_REGULAR))
    table = history.groupBy(F.col("host").alias("_k")).agg(F.max("reputation").cast("int").alias("_r"))
    return (df.join(table, F.col(host) == F.col("_k"), "left")
            .withColumn("reputation", F.coalesce("_r", F.lit(HOST_REGULAR))).drop("_k", "_r"))
