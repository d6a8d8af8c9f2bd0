"""The given tables seen as packets, messages, samples and host events.

Each view is written twice, as a DataFrame and as a SQL common table expression, with the same rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.bytes import computed_once
from weir.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- events as packets -----------------------------------------------------------------------------

def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream that ends with the rows there are."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# Rows of a micro-batch of a replayed table, whose memory is that of one batch, and files of each.
REPLAY_ROWS, REPLAY_FILES = 500_000, 4


def replayed(spark: SparkSession, sf_dir: str, name: str, order: str, rows: int | None = None) -> DataFrame:
    """A given table as a stream whose micro-batches follow the order of a column, each of about `rows` (REPLAY_ROWS) rows.

    The file source takes files by their time, so the parts are written one after the other. A table of up to `rows` rows is one part.
    """
    whole, rows = table(spark, sf_dir, name), REPLAY_ROWS if rows is None else rows
    n = whole.count()
    if n <= rows:
        return stream_table(spark, sf_dir, name)
    parts = -(-n // rows)
    bounds = whole.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (20 * parts))
    part = sum(F.coalesce((F.col(order) > F.lit(b)).cast("int"), F.lit(0)) for b in sorted(set(bounds)))
    dealt, path = scratch(spark, f"{name}-dealt"), scratch(spark, f"{name}-replay")
    whole.withColumn("_part", part).write.partitionBy("_part").parquet(dealt)
    for i in sorted(r[0] for r in spark.read.parquet(dealt).select("_part").distinct().collect()):
        own = spark.read.schema(whole.schema).parquet(f"{dealt}/_part={i}")
        own.repartition(REPLAY_FILES).write.parquet(f"{path}/part={i:06d}")
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", REPLAY_FILES).parquet(path)


# A capture whose clock is set back for single packets and by longer corrections.
STEP_BACK = " + CASE WHEN event_id % 7 = 3 THEN -1 WHEN event_id % 700 >= 600 THEN -25 ELSE 0 END"


def flow_packets(spark: SparkSession, sf_dir: str, clients: int = 15, per_second: int = 10,
                 ports: int = 40, events: DataFrame | None = None, steps_back: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events") if events is None else events
    out = F.col("event_type").isin("click", "view")
    port = (1024 + (F.col("event_id") * 7 + F.col("user_id")) % ports).cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        F.timestamp_seconds(F.expr(f"event_id div {per_second}" + STEP_BACK * steps_back)).alias("ts"),
        F.when(out, "OUT").otherwise("IN").alias("direction"),
        (F.col("user_id") % clients).alias("client_ip"),
        F.lit(0).cast("long").alias("server_ip"),
        F.when(out, port).otherwise(53).cast("int").alias("src_port"),
        F.when(out, 53).otherwise(port).cast("int").alias("dst_port"),
        F.floor(F.col("value") + 40).cast("int").alias("len"),
        (F.col("event_id") % 7).cast("int").alias("msg_id"),
    )


def flow_packets_sql(clients: int = 15, per_second: int = 10, ports: int = 40, steps_back: bool = False) -> str:
    port = f"CAST(1024 + (event_id * 7 + user_id) % {ports} AS INTEGER)"
    return f"""flow_packets AS (
  SELECT event_id AS seq, event_id // {per_second}{STEP_BACK * steps_back} AS t,
         CASE WHEN event_type IN ('click', 'view') THEN 'OUT' ELSE 'IN' END AS direction,
         user_id % {clients} AS client_ip, CAST(0 AS BIGINT) AS server_ip,
         CASE WHEN event_type IN ('click', 'view') THEN {port} ELSE 53 END AS src_port,
         CASE WHEN event_type IN ('click', 'view') THEN 53 ELSE {port} END AS dst_port,
         {port} AS client_port,
         CAST(floor(value + 40) AS INTEGER) AS len, event_id % 7 AS msg_id
  FROM events)"""


# ---- events and pages as messages ------------------------------------------------------------------

def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Each event asks for (OUT) or answers (IN) a name under the host of one page."""
    e = table(spark, sf_dir, "events") if events is None else events
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))
    pages = table(spark, sf_dir, "pages")
    n = F.lit(pages.count()) if e.isStreaming else pages.agg(F.count(F.lit(1))).scalar()
    i = F.col("event_id")
    out = F.col("event_type").isin("click", "view")
    word = F.when(i % 5 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    bad = i % 40 == 7
    return (
        e.withColumn("_page", i % n).join(p, F.col("_page") == F.col("page_id"))
        .select(
            i.alias("seq"), F.timestamp_seconds(i).alias("ts"),
            F.when(out, "OUT").otherwise("IN").alias("direction"),
            (F.col("user_id") % 15).alias("client_ip"), (i % 6).alias("server_ip"),
            F.floor(F.col("value") + 40).cast("int").alias("len"),
            F.when(bad, 1).otherwise(0).alias("packet_code"),
            F.when(~bad, F.concat(word, F.lit("-"), (i % 97).cast("string"), F.lit("."), "host", F.lit("."))).alias("qname"),
            F.when(i % 50 == 0, 0).otherwise(1).alias("qdcount"),
            F.when(out, 0).otherwise(1 + i % 3).cast("int").alias("ancount"),
            F.when(i % 11 == 0, 1).otherwise(0).alias("nscount"),
            F.when(i % 4 == 0, 1).otherwise(0).alias("arcount"),
            F.when(~out, i * 37 % 1000 * F.when(i % 20 == 0, 1000).when(i % 20 == 2, 0).otherwise(1)).alias("ttl"),
        )
    )


MESSAGES_SQL = """messages AS (
  SELECT event_id AS seq, event_id AS t,
    CASE WHEN event_type IN ('click', 'view') THEN 'OUT' ELSE 'IN' END AS direction,
    user_id % 15 AS client_ip, event_id % 6 AS server_ip, CAST(floor(value + 40) AS INTEGER) AS len,
    CASE WHEN event_id % 40 = 7 THEN 1 ELSE 0 END AS packet_code,
    CASE WHEN event_id % 40 <> 7 THEN
      CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END || '-' || CAST(event_id % 97 AS VARCHAR)
      || '.' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '.' END AS qname,
    CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 END AS qdcount,
    CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 + event_id % 3 END AS ancount,
    CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS nscount,
    CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS arcount,
    CASE WHEN event_type NOT IN ('click', 'view') THEN event_id * 37 % 1000
      * CASE WHEN event_id % 20 = 0 THEN 1000 WHEN event_id % 20 = 2 THEN 0 ELSE 1 END END AS ttl
  FROM events JOIN pages ON event_id % (SELECT count(*) FROM pages) = page_id)"""


# ---- embeddings as labelled samples ----------------------------------------------------------------

def samples(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    """Label 0 is the normal class. `width` keeps the first values, as a flow vector."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("row_id"),
        (vec if width is None else F.slice(vec, 1, width)).alias("features"),
        F.col("label").cast("string").alias("source"),
        F.when(F.col("label") == 0, "P").otherwise("N").alias("label"))


def samples_sql(width: int | None = None) -> str:
    vec = "CAST(embedding AS DOUBLE[])" if width is None else f"CAST(embedding[1:{width}] AS DOUBLE[])"
    return f"""samples AS (
  SELECT vec_id AS row_id, {vec} AS features, CAST(label AS VARCHAR) AS source,
    CASE WHEN label = 0 THEN 'P' ELSE 'N' END AS label FROM embeddings),
cells AS (
  SELECT row_id, source, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS pos FROM samples)"""


def centroids(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    """Mean vector of each embedding label."""
    cells = samples(spark, sf_dir, width).select(
        F.col("source").cast("long").alias("cid"), F.posexplode("features").alias("pos", "v"))
    means = cells.groupBy("cid", "pos").agg(F.avg("v").alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("cid").agg(F.transform(ordered, lambda p: p["m"]).alias("vec"))


CENTROIDS_SQL = """centroids AS (
  SELECT CAST(source AS BIGINT) AS cid, pos, avg(v) AS c FROM cells GROUP BY ALL),
distances AS (
  SELECT row_id, cid, sqrt(sum((v - c) * (v - c))) AS dist FROM cells JOIN centroids USING (pos) GROUP BY ALL),
nearest AS (
  SELECT row_id, cid, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) AS r FROM distances) WHERE r = 1)"""


def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of small whole numbers, like packed pattern bytes."""
    return samples(spark, sf_dir, 7).withColumn(
        "features", F.transform("features", lambda v: F.floor(F.abs(v) * 500).cast("double")))


PACKED_SQL = """samples AS (
  SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS source,
    [floor(abs(CAST(v AS DOUBLE)) * 500) for v in embedding[1:7]] AS features,
    CASE WHEN label = 0 THEN 'P' ELSE 'N' END AS label FROM embeddings),
cells AS (
  SELECT row_id, source, label, CAST(unnest(features) AS BIGINT) AS v, generate_subscripts(features, 1) - 1 AS pos FROM samples)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for queries that write and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- messages as wire bytes ------------------------------------------------------------------------

CLIENT_BASE, SERVER_BASE = 10 * 16777216, 8 * 16777216 + 8 * 65536 + 8 * 256


def wire_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message view written as IPv4 packets, UDP or TCP, with some packets spoiled by `seq % 40`."""
    m = messages(spark, sf_dir)
    i, out, k = F.col("seq"), F.col("direction") == "OUT", F.col("seq") % 40
    m = m.withColumn("qname", F.coalesce("qname", F.lit("spoiled.")))

    def h(value, digits: int):
        value = F.lit(value) if isinstance(value, int) else value
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    an, ns, ar = F.col("ancount"), F.col("nscount"), F.col("arcount")
    labels = F.transform(F.split(F.rtrim(F.col("qname"), F.lit(".")), r"\."), lambda x: F.concat(h(F.length(x), 2), F.hex(x)))
    name = F.when(k == 10, F.lit("C00C")).when(k == 11, F.lit("FFFF")).otherwise(F.concat(F.array_join(labels, ""), F.lit("00")))
    answers = F.array_join(F.transform(
        F.when(an > 0, F.sequence(F.lit(1), F.greatest(an, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda j: F.concat(F.lit("C00C00010001"), h(F.col("ttl"), 8), F.lit("00040A"), h(i % 256, 2), h(j, 2), F.lit("07"))), "")
    authority = F.when(ns == 1, F.lit("C00C000200010000012C0005026E73C00C")).otherwise("")
    opt_ttl = F.when(i % 8 == 0, 0x8000).otherwise(0) + F.when(i % 3 == 0, 0x01000000).otherwise(0)
    extra = F.when(ar == 1, F.concat(F.lit("0000291000"), h(opt_ttl, 8), F.lit("0000"))).otherwise("")
    flags = F.when(out, 0x0100).otherwise(0x8180 + F.when(i % 4 == 0, 3).otherwise(0))
    dns = F.concat(h(i % 65536, 4), h(flags, 4), h(F.when(k == 9, 2).otherwise(1), 4), h(an, 4), h(ns, 4),
                   h(F.when(k == 12, ar + 1).otherwise(ar), 4), name, h(F.when(i % 2 == 0, 1).otherwise(28), 4), F.lit("0001"),
                   answers, authority, extra)
    m = computed_once(m, {"_dns": dns}).withColumn("_n", (F.length("_dns") / 2).cast("int"))
    client, server = F.col("client_ip") + CLIENT_BASE, F.col("server_ip") + SERVER_BASE
    tcp = (i % 6 == 5) & ~k.between(7, 12)
    proto = F.when(k == 8, 1).when(tcp, 6).otherwise(17)
    total = F.col("_n") + F.when(tcp, 42).otherwise(28)
    ip = F.concat(F.lit("4500"), h(total, 4), F.lit("0000000040"), h(proto, 2), F.lit("0000"),
                  h(F.when(out, client).otherwise(server), 8), h(F.when(out, server).otherwise(client), 8))
    port = 1024 + (i * 7) % 4000
    ports = F.concat(h(F.when(out, port).otherwise(53), 4), h(F.when(out, 53).otherwise(port), 4))
    udp = F.concat(ports, h(F.col("_n") + 8, 4), F.lit("0000"))
    body = F.concat(ip, F.when(tcp, F.concat(ports, F.lit("00000000000000005000FFFF00000000"), h(F.col("_n"), 4))).otherwise(udp), F.col("_dns"))
    payload = F.unhex(F.when(k == 7, F.substring(body, 1, 20)).otherwise(body))
    made = m.select("ts", "seq", "direction", F.lit("eth0").alias("iface"), payload.alias("payload")).select(
        "ts", "seq", "direction", "iface", F.length("payload").alias("captured_len"), "payload")
    # captures are a stored table; without this cut the optimizer would rebuild the bytes at every read of one
    ensure_checkpoint_dir(spark)
    return made.checkpoint()


WIRE_SQL = MESSAGES_SQL + f""",
wire AS (SELECT * REPLACE (coalesce(qname, 'spoiled.') AS qname), seq % 40 AS k, seq % 40 BETWEEN 7 AND 12 AS spoiled,
    seq % 6 = 5 AND seq % 40 NOT BETWEEN 7 AND 12 AS tcp,
    CAST(client_ip + {CLIENT_BASE} AS BIGINT) AS client, CAST(server_ip + {SERVER_BASE} AS BIGINT) AS server,
    12 + CASE WHEN seq % 40 IN (10, 11) THEN 2 ELSE length(coalesce(qname, 'spoiled.')) + 1 END + 4
      + ancount * 16 + nscount * 17 + arcount * 11 AS n,
    CASE WHEN direction = 'OUT' THEN 256 ELSE 33152 + CASE WHEN seq % 4 = 0 THEN 3 ELSE 0 END END AS flags,
    (CASE WHEN seq % 8 = 0 THEN 32768 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 16777216 ELSE 0 END) * arcount AS opt
  FROM messages)"""
