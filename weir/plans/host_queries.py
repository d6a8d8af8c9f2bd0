"""Host events, snapshots and configuration files over text and rows made of the given tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from weir.operators import hostevents as H
from weir.plans.bindings import scratch, table
from weir.plans.catalog import query
from weir.sources import configs as C
from weir.sources import eventlog
from weir.sources import processes as R
from weir.sources import sockets as K


def count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# ---- host events -----------------------------------------------------------------------------------

def host_events(spark, sf_dir, events=None):
    """Clicks and views fold in slot 1; one event per second."""
    e = table(spark, sf_dir, "events") if events is None else events
    folds = F.col("event_type").isin("click", "view")
    rows = e.select(
        F.timestamp_seconds("event_id").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("code"),
        (F.col("user_id") % 3).cast("string").alias("name"), F.lit("_un_").alias("cause"), F.col("value"),
        (F.col("event_id") % 5).alias("other"), F.when(folds, 1).cast("int").alias("agg_col"))
    return H.build_events(rows, {0: F.col("value"), 3: F.col("other")}).select(*H.COLUMNS)


EVENTS_SQL = """host_events AS (SELECT event_id AS seq, event_id // 12 * 12 AS win, event_type AS code,
  CAST(user_id % 3 AS VARCHAR) AS name, value AS s1, (event_id % 5)::DOUBLE AS s4, event_type IN ('click', 'view') AS folds FROM events),
folded AS (SELECT win, code, name, min(seq) AS seq, sum(s1) AS s1, min_by(s4, seq) AS s4 FROM host_events WHERE folds GROUP BY ALL
  UNION ALL SELECT win, code, name, seq, s1, s4 FROM host_events WHERE NOT folds)"""


def slots(df, *keep):
    return df.select(*keep, F.round(F.get("vec", F.lit(1)), 6).alias("s1"), F.get("vec", F.lit(4)).alias("s4"))


@query("build_events", f"WITH {EVENTS_SQL} SELECT seq, code, name, round(s1, 6) AS s1, s4, 6 AS width FROM host_events")
def _build(spark, sf_dir):
    return slots(host_events(spark, sf_dir), "seq", "code", "name", F.size("vec").alias("width"))


# DuckDB has no CRC-32; the byte of each event type is put into the twin.
BYTES = " ".join(f"WHEN '{t}' THEN {zlib.crc32(t.encode()) % 256}" for t in ("click", "error", "purchase", "signup", "view"))


@query("code_byte", f"SELECT event_type, (CASE event_type {BYTES} END)::DOUBLE AS byte, count(*) AS n FROM events GROUP BY ALL")
def _byte(spark, sf_dir):
    return count(table(spark, sf_dir, "events").select("event_type", H.code_byte(F.col("event_type")).alias("byte")), "event_type", "byte")


@query("aggregate_events", f"WITH {EVENTS_SQL} SELECT win, seq, code, name, round(s1, 6) AS s1, s4 FROM folded")
def _aggregate(spark, sf_dir):
    d = H.aggregate_events(host_events(spark, sf_dir))
    return slots(d, F.unix_seconds("window_start").alias("win"), "seq", "code", "name")


@query("drain_events", f"WITH {EVENTS_SQL} SELECT win, name, count(*) AS n, round(sum(s1), 6) AS s1 FROM folded GROUP BY ALL")
def _drain(spark, sf_dir):
    return H.drain_events(host_events(spark, sf_dir)).groupBy(F.unix_seconds("window_start").alias("win"), "name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("vec", F.lit(1))), 6).alias("s1"))


@query("collect_features", f"WITH {EVENTS_SQL} SELECT round(s1, 6) AS s1, s4 FROM folded")
def _features(spark, sf_dir):
    return slots(H.collect_features(host_events(spark, sf_dir)))


@query("event_archive", f"WITH {EVENTS_SQL} SELECT code, count(*) AS n, round(sum(s1), 6) AS s1 FROM host_events GROUP BY ALL")
def _archive(spark, sf_dir):
    path = scratch(spark, "archive")
    eventlog.write_event_archive(host_events(spark, sf_dir), path)
    return eventlog.read_event_archive(spark, path).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("features", F.lit(1))), 6).alias("s1"))


# The profile is made of the first hundredth of the events; later ones that lie 60 or more from its centroids grow it. The twin
# finds the leaders of both parts one after the other.
TRAINING, EVENT_RADIUS = 100, 60.0
LEADERS_SQL = """{name}_left(step, seq, v) AS (SELECT 0, seq, v FROM {rows} UNION ALL
  SELECT step + 1, seq, v FROM (SELECT step, seq, v, first_value(v) OVER (ORDER BY seq) AS lead FROM {name}_left) WHERE list_distance(v, lead) >= 60),
{name}_book AS (SELECT step + {first} AS cid, arg_min(v, seq) AS c FROM {name}_left GROUP BY step),
{name}_near AS (SELECT seq, arg_min(cid, (list_distance(v, c), cid)) AS cid, min(list_distance(v, c)) AS dist FROM {asked}, {name}_book GROUP BY seq)"""
GROWN_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
vecs AS (SELECT seq, [(CASE code {BYTES} END)::DOUBLE, s1, 0, 0, s4, 0]::DOUBLE[] AS v FROM host_events),
early AS (SELECT * FROM vecs WHERE seq * {TRAINING} < (SELECT max(event_id) + 1 FROM events)), rest AS (SELECT * FROM vecs WHERE seq NOT IN (SELECT seq FROM early)),
{LEADERS_SQL.format(name='old', rows='early', first='0', asked='rest')},
far AS (SELECT * FROM rest WHERE seq IN (SELECT seq FROM old_near WHERE dist >= {EVENT_RADIUS})),
{LEADERS_SQL.format(name='new', rows='far', first='(SELECT count(*) FROM old_book)', asked='far')},
told AS (SELECT seq, cid, dist, false AS grown FROM old_near WHERE dist < {EVENT_RADIUS} UNION ALL SELECT seq, cid, dist, true FROM new_near)
SELECT cid, grown, count(*) AS n, round(max(dist), 6) AS radius FROM told GROUP BY cid, grown"""


def event_periods(spark, sf_dir):
    """The training events, and the others."""
    e = host_events(spark, sf_dir)
    n = e.agg(F.max("seq") + 1).first()[0]
    early = F.col("seq") * TRAINING < n
    return e.where(early), early


def grown_clusters(near):
    return near.groupBy("cid", "grown").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("dist"), 6).alias("radius"))


@query("cluster_events", GROWN_SQL)
def _cluster(spark, sf_dir):
    training, early = event_periods(spark, sf_dir)
    near, _ = H.cluster_events(host_events(spark, sf_dir).where(~early), H.lead_event_profile(training, EVENT_RADIUS))
    return grown_clusters(near)


# ---- socket snapshots ------------------------------------------------------------------------------

def socket_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    udp = i % 4 == 0
    number = i.cast("string")
    state = F.when(udp, "").when(i % 3 == 0, "LISTEN      ").otherwise("ESTABLISHED ")
    program = F.when(i % 5 == 0, "-").otherwise(F.concat((i % 900).cast("string"), F.lit("/"), F.col("event_type"), F.lit("d")))
    line = F.concat(F.when(udp, "udp     ").otherwise("tcp     "), (i % 7).cast("string"), F.lit("    "), (i % 11).cast("string"),
                    F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(":"), (1024 + i % 3000).cast("string"),
                    F.lit("     8.8.8.8:"), F.when(i % 6 == 0, "*").otherwise("53"), F.lit("      "), state,
                    F.lit("root    "), number, F.lit("     "), program)
    return e.select(F.timestamp_seconds(i).alias("ts"), i.alias("seq"), line.alias("value"))


SOCKET_SQL = """sockets AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
  CAST(event_id % 7 AS VARCHAR) AS recv_q, CAST(event_id % 11 AS VARCHAR) AS send_q, '10.0.0.' || (user_id % 250) AS local_address,
  CAST(1024 + event_id % 3000 AS VARCHAR) AS local_port, '8.8.8.8' AS foreign_address,
  CASE WHEN event_id % 6 = 0 THEN '*' ELSE '53' END AS foreign_port,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'LISTEN' ELSE 'ESTABLISHED' END AS state, 'root' AS user,
  CAST(event_id AS VARCHAR) AS inode, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 900 AS VARCHAR) END AS pid,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || 'd' END AS program FROM events)"""


def sockets(spark, sf_dir):
    return K.parse_socket_snapshot(socket_lines(spark, sf_dir), "linux")


@query("parse_sockets_linux", f"WITH {SOCKET_SQL} SELECT * FROM sockets")
def _linux(spark, sf_dir):
    return sockets(spark, sf_dir).drop("ts")


@query("parse_sockets_unix", """SELECT event_id AS seq, 'unix' AS proto, CAST(2 + event_id % 3 AS VARCHAR) AS ref_count,
CASE WHEN event_id % 3 = 0 THEN 'ACC' WHEN event_id % 3 = 1 THEN '' ELSE 'ACC W' END AS flags,
CASE WHEN event_id % 2 = 0 THEN 'DGRAM' ELSE 'STREAM' END AS type, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'CONNECTED' END AS state,
CAST(event_id AS VARCHAR) AS inode, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 900 AS VARCHAR) END AS pid,
CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || 'd' END AS program,
CASE WHEN event_id % 4 = 0 THEN '' ELSE '/run/my ' || event_type || '/sock' END AS path FROM events""")
def _unix(spark, sf_dir):
    i = F.col("event_id")
    program = F.when(i % 5 == 0, "-").otherwise(F.concat((i % 900).cast("string"), F.lit("/"), F.col("event_type"), F.lit("d")))
    line = F.concat(F.lit("unix  "), (2 + i % 3).cast("string"), F.lit("      [ "),
                    F.when(i % 3 == 0, "ACC ").when(i % 3 == 1, "").otherwise("ACC W "), F.lit("]         "),
                    F.when(i % 2 == 0, "DGRAM                    ").otherwise("STREAM     CONNECTED     "), i.cast("string"), F.lit("    "),
                    program, F.lit("   "), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("/run/my "), "event_type", F.lit("/sock"))))
    return K.parse_socket_snapshot(table(spark, sf_dir, "events").select(i.alias("seq"), line.alias("value")), "unix")


@query("parse_sockets_nt", """SELECT event_id AS snapshot, proto, '0.0.0.0' AS local_address, CAST(1024 + event_id % 3000 AS VARCHAR) AS local_port,
'host-' || user_id AS foreign_address, '0' AS foreign_port, CASE WHEN proto = 'TCP' THEN 'LISTENING' ELSE '' END AS state,
CAST(event_id AS VARCHAR) AS pid, CASE WHEN proto = 'UDP' THEN '' WHEN event_id % 2 = 0 THEN '[' || event_type || '.exe]'
ELSE event_type || '[svc.exe]' END AS program FROM events, (SELECT unnest(['TCP', 'UDP']) AS proto)""")
def _nt(spark, sf_dir):
    i = F.col("event_id")
    rest = F.concat(F.lit("    0.0.0.0:"), (1024 + i % 3000).cast("string"), F.lit("            host-"), F.col("user_id").cast("string"), F.lit(":0         "))
    program = F.when(i % 2 == 0, F.concat(F.lit(" ["), "event_type", F.lit(".exe]\r\n"))).otherwise(
        F.concat(F.lit("  "), "event_type", F.lit("\r\n [svc.exe]\r\n")))
    text = F.concat(F.lit("\r\nActive Connections\r\n\r\n  Proto  Local Address          Foreign Address        State           PID\r\n"),
                    F.lit("  TCP"), rest, F.lit("LISTENING       "), i.cast("string"), F.lit("\r\n"), program,
                    F.lit("  UDP"), rest, i.cast("string"), F.lit("\r\n"))
    return K.parse_socket_snapshot(table(spark, sf_dir, "events").select(i.alias("snapshot"), text.alias("value")), "nt")


@query("select_field", f"WITH {SOCKET_SQL} SELECT program, count(*) AS n FROM sockets GROUP BY ALL")
def _field(spark, sf_dir):
    return count(K.select_field(sockets(spark, sf_dir), "program"), "program")


@query("find_keyword", f"WITH {SOCKET_SQL} SELECT seq FROM sockets WHERE concat_ws('|', proto, local_address, local_port, foreign_address, "
                       "foreign_port, state, user, inode, pid, program, recv_q, send_q) LIKE '%777%'")
def _keyword(spark, sf_dir):
    return K.find_keyword(sockets(spark, sf_dir), "777").select("seq")


@query("filter_family", f"WITH {SOCKET_SQL} SELECT proto, state, count(*) AS n FROM sockets WHERE proto = 'tcp' AND state = 'LISTEN' GROUP BY ALL")
def _family(spark, sf_dir):
    return count(K.filter_family(sockets(spark, sf_dir), ["tcp"], listening=True), "proto", "state")


@query("write_connections", f"WITH {SOCKET_SQL} SELECT proto, local_address, count(*) AS n FROM sockets GROUP BY ALL")
def _write(spark, sf_dir):
    path = scratch(spark, "connections")
    K.write_connections(sockets(spark, sf_dir).drop("ts", "seq"), path)
    return count(spark.read.option("sep", "|").option("header", True).csv(path), "proto", "local_address")


@query("socket_events", f"""WITH {SOCKET_SQL}, port AS (SELECT *, CAST(local_port AS INTEGER) AS p,
  CASE WHEN foreign_port = '*' THEN 0 ELSE CAST(foreign_port AS INTEGER) END AS r FROM sockets)
SELECT 6 * seq AS seq, 'net' || state AS code, 'Lroot' || p AS name, p::DOUBLE AS s3, 0::DOUBLE AS s4, CAST(NULL AS INTEGER) AS agg_col FROM port
UNION ALL SELECT 6 * seq + 1, 'net' || state, 'Lroot' || program, p, 0, 3 FROM port
UNION ALL SELECT 6 * seq + 2, 'net' || state, 'LQ' || recv_q || send_q, 0, 0, NULL FROM port
UNION ALL SELECT 6 * seq + 3, 'net', 'R' || p || foreign_address, 0, 2, 4 FROM port
UNION ALL SELECT 6 * seq + 4, 'net', 'R' || proto || r, 0, 2, 4 FROM port
UNION ALL SELECT 6 * seq + 5, 'net', 'S' || proto, 0, 0, 2 FROM port""")
def _socket_events(spark, sf_dir):
    return H.socket_events(sockets(spark, sf_dir)).select(
        "seq", "code", "name", F.get("vec", F.lit(3)).alias("s3"), F.get("vec", F.lit(4)).alias("s4"), "agg_col")


# ---- processes -------------------------------------------------------------------------------------

def process_lines(spark, sf_dir):
    """One process per event; a snapshot covers a hundred events."""
    i = F.col("event_id")
    line = F.concat(F.lit("  09:15  "), F.round("value", 2).cast("string"), F.lit("   "), (i % 100).cast("string"), F.lit("    "),
                    (i * 13 % 5000).cast("string"), F.lit("  "), F.col("event_type"), F.lit(" --id "), i.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.timestamp_seconds(i + 100_000).alias("ts"), i.alias("seq"), F.expr("event_id div 100").alias("snapshot"), line.alias("value"))


PROCESS_SQL = """processes AS (SELECT event_id AS seq, event_id + 100000 AS t, event_id // 100 AS snapshot, '09:15' AS bsdstart, round(value, 2) AS pmem,
  event_id % 100 AS pcpu, event_id * 13 % 5000 AS etimes, event_type || ' --id ' || event_id AS command FROM events)"""


def processes(spark, sf_dir):
    return R.parse_process_snapshot(process_lines(spark, sf_dir))


@query("parse_processes", f"WITH {PROCESS_SQL} SELECT seq, bsdstart, pmem, pcpu, etimes, command FROM processes")
def _processes(spark, sf_dir):
    return processes(spark, sf_dir).select("seq", "bsdstart", F.col("pmem").cast("double").alias("pmem"),
                                           F.col("pcpu").cast("long").alias("pcpu"), F.col("etimes").cast("long").alias("etimes"), "command")


@query("top_processes", f"""WITH {PROCESS_SQL} SELECT snapshot, command, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY snapshot ORDER BY pmem DESC, command) AS rank FROM processes) WHERE rank <= 20""")
def _top(spark, sf_dir):
    return H.top_processes(processes(spark, sf_dir), "pmem", 20).select("snapshot", "command", "rank")


@query("process_events", f"""WITH {PROCESS_SQL} SELECT seq, 'proc' AS code, 'etimes' || etimes AS name, command AS cause, pmem AS s3,
pcpu::DOUBLE AS s4, round((t - etimes)::DOUBLE / 300, 6) AS start_bucket FROM processes""")
def _process_events(spark, sf_dir):
    return H.process_events(processes(spark, sf_dir)).select(
        "seq", "code", "name", "cause", F.get("vec", F.lit(3)).alias("s3"), F.get("vec", F.lit(4)).alias("s4"),
        F.round("start_bucket", 6).alias("start_bucket"))


@query("start_bucket", f"WITH {PROCESS_SQL} SELECT CAST(floor((t - etimes)::DOUBLE / 300) AS BIGINT) AS bucket, count(*) AS n FROM processes GROUP BY ALL")
def _bucket(spark, sf_dir):
    p = processes(spark, sf_dir)
    return count(p.select(F.floor(H.start_bucket(F.col("ts"), F.col("etimes"))).alias("bucket")), "bucket")


@query("parse_system_summary", """SELECT event_id AS snapshot, round((event_id % 900 + 100)::DOUBLE / 8000, 6) AS pmem, CAST(event_id % 90 AS VARCHAR) || '.5' AS pcpu,
CAST(event_id % 400 AS VARCHAR) AS num_tasks FROM events""")
def _system(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit("top - 10:00:00 up 1 day\nTasks: 210 total, 1 running, "), (i % 400).cast("string"),
                    F.lit(" sleeping\n%Cpu(s): "), (i % 90).cast("string"), F.lit(".5 us, 1.0 sy\nKiB Mem : 8000 total, "),
                    (i % 900 + 100).cast("string"), F.lit(" used, 5 free\nKiB Swap: 0 total"))
    d = R.parse_system_summary(table(spark, sf_dir, "events").select(i.alias("snapshot"), text.alias("value")))
    return d.select("snapshot", F.round("pmem", 6).alias("pmem"), "pcpu", "num_tasks")


# ---- file activity ---------------------------------------------------------------------------------

ACTIONS = ["ACCESS", "OPEN", "ATTRIB", "CLOSE_WRITE", "MODIFY", "CREATE", "DELETE", "IGNORED"]
FOLDERS = ["dev", "etc", "root", "home", "lib", "usr", "bin"]


def activity(spark, sf_dir):
    i = F.col("event_id")
    path = F.concat(F.lit("/"), F.element_at(F.array(*map(F.lit, FOLDERS)), (i % 7 + 1).cast("int")), F.lit("/"), "event_type")
    return table(spark, sf_dir, "events").select(
        F.timestamp_seconds(i).alias("ts"), i.alias("seq"), F.element_at(F.array(*map(F.lit, ACTIONS)), (i % 8 + 1).cast("int")).alias("action"),
        path.alias("path"))


ACTIVITY_SQL = f"""activity AS (SELECT event_id AS seq, {ACTIONS}[event_id % 8 + 1] AS action, {FOLDERS}[event_id % 7 + 1] AS top,
  '/' || {FOLDERS}[event_id % 7 + 1] || '/' || event_type AS path FROM events),
levels AS (SELECT *, CASE WHEN action IN ('ACCESS', 'OPEN') THEN CASE top WHEN 'dev' THEN 5 WHEN 'etc' THEN 2 ELSE 1 END
  WHEN action IN ('ATTRIB', 'CLOSE_WRITE', 'MODIFY') THEN CASE top WHEN 'dev' THEN 3 WHEN 'root' THEN 15 WHEN 'bin' THEN 8 WHEN 'lib' THEN 8 WHEN 'etc' THEN 6 ELSE 1 END
  ELSE CASE WHEN top IN ('root', 'bin', 'lib') THEN 10 ELSE 2 END END AS level FROM activity WHERE action <> 'IGNORED')"""


@query("file_events", f"""WITH {ACTIVITY_SQL} SELECT seq, CASE action WHEN 'ACCESS' THEN 'ACC:' WHEN 'OPEN' THEN 'OPN:' WHEN 'ATTRIB' THEN 'ATT:'
WHEN 'CLOSE_WRITE' THEN 'WRT:' WHEN 'MODIFY' THEN 'CHG:' WHEN 'CREATE' THEN 'NEW:' ELSE 'DEL:' END || path AS name,
CASE WHEN action IN ('ACCESS', 'OPEN') THEN 0 ELSE level END::DOUBLE AS s2, CASE WHEN action IN ('ACCESS', 'OPEN') THEN level ELSE 0 END::DOUBLE AS s3 FROM levels""")
def _file_events(spark, sf_dir):
    return H.file_events(activity(spark, sf_dir)).select("seq", "name", F.get("vec", F.lit(2)).alias("s2"), F.get("vec", F.lit(3)).alias("s3"))


@query("path_sensitivity", f"WITH {ACTIVITY_SQL} SELECT top, CASE WHEN action IN ('ACCESS', 'OPEN') THEN 'read' "
                           "WHEN action IN ('CREATE', 'DELETE') THEN 'create' ELSE 'write' END AS kind, level, count(*) AS n FROM levels GROUP BY ALL")
def _sensitivity(spark, sf_dir):
    a = activity(spark, sf_dir).where("action <> 'IGNORED'")
    kind = F.when(F.col("action").isin("ACCESS", "OPEN"), "read").when(F.col("action").isin("CREATE", "DELETE"), "create").otherwise("write")
    d = a.select(F.split("path", "/")[1].alias("top"), kind.alias("kind"), "path")
    return count(d.withColumn("level", H.path_sensitivity(F.col("path"), F.col("kind"))), "top", "kind", "level")


@query("union_events", f"""WITH {ACTIVITY_SQL} SELECT 'fs' AS kind, count(*) AS n FROM levels
UNION ALL SELECT 'net', 6 * count(*) FROM events UNION ALL SELECT 'proc', count(*) FROM events""")
def _union(spark, sf_dir):
    d = H.union_events(H.socket_events(sockets(spark, sf_dir)), H.process_events(processes(spark, sf_dir)), H.file_events(activity(spark, sf_dir)))
    return count(d.withColumn("kind", F.regexp_extract("code", "^(net|proc|fs)", 1)), "kind")


# ---- configuration ---------------------------------------------------------------------------------

def text_file(spark, sf_dir, name, lines):
    path = scratch(spark, name)
    lines.write.text(path)
    return path


@query("read_settings", "SELECT s_name AS key, 'n ' || s_nationkey AS value FROM supplier WHERE s_suppkey % 3 <> 0")
def _settings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.lit("a:b:c")).otherwise(
        F.concat(F.lit("  "), "s_name", F.lit(" :  n "), F.col("s_nationkey").cast("string"), F.lit("  ")))
    return C.read_settings(spark, text_file(spark, sf_dir, "settings", s.select(key.alias("value"))))


@query("read_service_ports", "SELECT s_name AS service, unnest([s_suppkey + 1, s_suppkey + 1000]) AS port FROM supplier WHERE s_suppkey % 4 <> 0")
def _ports(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    line = F.concat("s_name", F.lit(" : "), F.when(k % 4 == 0, "none, x").otherwise(
        F.concat((k + 1).cast("string"), F.lit(", http, "), (k + 1000).cast("string"))))
    return C.read_service_ports(spark, text_file(spark, sf_dir, "ports", s.select(line.alias("value"))))


@query("read_nameservers", "SELECT unnest(['10.0.0.' || s_suppkey % 250, '10.1.0.' || s_suppkey % 250]) AS address FROM supplier WHERE s_suppkey % 5 > 1")
def _nameservers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = (F.col("s_suppkey") % 250).cast("string")
    line = F.when(F.col("s_suppkey") % 5 == 0, "# nameserver 1.1.1.1").when(F.col("s_suppkey") % 5 == 1, "search example.org").otherwise(
        F.concat(F.lit("  nameserver 10.0.0."), n, F.lit("  10.1.0."), n))
    return C.read_nameservers(spark, text_file(spark, sf_dir, "resolver", s.select(line.alias("value"))))
