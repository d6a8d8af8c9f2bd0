"""Streaming forms run over the given tables until their rows are used up, next to the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions.vectors import last_features
from weir.operators import domains as D
from weir.operators import graph as G
from weir.operators import profiles as P
from weir.operators.flows import FEATURES, flow_features
from weir.operators.hostevents import lead_event_profile
from weir.plans import domain_queries as DQ
from weir.plans import host_queries as HQ
from weir.plans.bindings import flow_packets, messages, replayed, scratch, stream_table
from weir.plans.catalog import ORACLES, query
from weir.plans.bindings import MESSAGES_SQL, flow_packets_sql
from weir.plans.flow_queries import KEY, _features_sql
from weir.sources import packets as S
from weir.streaming import events as SE
from weir.streaming import flows as SF


def settled(spark, df, name, mode="append"):
    """Run a stream to its end into files and read them back."""
    path = scratch(spark, name)
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, f"{name}-state"))
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


# Streams start a day into the epoch: a watermark starts at its first second, and counts what is not after it as late.
DAY = 86400


def later(df):
    return df.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {DAY} SECONDS"))


def packet_stream(spark, sf_dir):
    return later(flow_packets(spark, sf_dir, events=replayed(spark, sf_dir, "events", "event_id")))


def message_stream(spark, sf_dir, events=None):
    e = stream_table(spark, sf_dir, "events") if events is None else events
    return later(messages(spark, sf_dir, events=e)).where("qname is not null")


def features(df):
    return [F.get("features", F.lit(i)).cast("long").alias(c) for i, c in enumerate(FEATURES)]


@query("stream_flow_features", ORACLES["flow_features"])
def _flow(spark, sf_dir):
    d = settled(spark, SF.stream_flow_features(packet_stream(spark, sf_dir)), "flow-stream")
    return d.select(*KEY, *features(d))


# A flow that is idle for over five seconds starts afresh: each of its visits is a flow of its own.
VISITS_SQL = flow_packets_sql().replace("flow_packets AS (", "every_packet AS (", 1) + """,
visits AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 5
  THEN 1 ELSE 0 END AS fresh FROM every_packet),
flow_packets AS (SELECT * EXCLUDE (fresh) REPLACE (client_ip + 1000 * sum(fresh) OVER (PARTITION BY client_ip, server_ip ORDER BY seq) AS client_ip) FROM visits)"""


@query("stream_flow_idle", "SELECT seq, " + ", ".join(FEATURES) + " FROM (" + _features_sql(", ".join(FEATURES)).replace(flow_packets_sql(), VISITS_SQL) + ")")
def _flow_idle(spark, sf_dir):
    d = settled(spark, SF.stream_flow_features(packet_stream(spark, sf_dir), idle_ms=5000), "idle-stream")
    return d.select("seq", *features(d))


def tail_profile(spark, sf_dir):
    """Two fixed rows of the batch features, reduced, as centroids."""
    f = flow_features(flow_packets(spark, sf_dir)).where("seq in (500, 900)").select(
        F.when(F.col("seq") == 500, 0).otherwise(1).cast("long").alias("cid"), last_features(F.col("features")).alias("vec"))
    rows = f.collect()
    c = spark.createDataFrame([(r.cid, r.vec) for r in rows], "cid long, vec array<double>")
    return P.Profile(P._labelled(c), 60.0, 20.0, 2)


LAST10 = ", ".join(FEATURES[-10:])
SCORE_SQL = _features_sql(f"[{LAST10}]::DOUBLE[] AS v")
STREAM_SCORE_SQL = f"""SELECT client_ip, server_ip, seq, round(least(d0, d1), 6) AS dist, CASE WHEN least(d0, d1) < 60 THEN -3 ELSE 1 END AS packet_score,
  CASE WHEN least(d0, d1) < 60 THEN 'ACCEPT' ELSE 'DROP' END AS verdict
FROM (SELECT a.client_ip, a.server_ip, a.seq, list_distance(a.v, (SELECT v FROM f WHERE seq = 500)) AS d0,
  list_distance(a.v, (SELECT v FROM f WHERE seq = 900)) AS d1 FROM f a)"""


@query("stream_score", f"WITH f AS ({SCORE_SQL}) {STREAM_SCORE_SQL}")
def _score(spark, sf_dir):
    s = SF.stream_score(packet_stream(spark, sf_dir), tail_profile(spark, sf_dir), reduce=last_features)
    d = settled(spark, s.select(*KEY, "dist", "packet_score", "verdict"), "score-stream")
    return d.select(*KEY, F.round("dist", 6).alias("dist"), "packet_score", "verdict")


@query("stream_score_feed", f"WITH f AS ({SCORE_SQL}) SELECT point, score, count(*) AS n FROM (SELECT '[' || array_to_string("
       f"[CAST(x AS BIGINT) for x in f.v], ', ') || ']' AS point, CASE WHEN packet_score = -3 THEN '1' ELSE '0' END AS score "
       f"FROM ({STREAM_SCORE_SQL}) s JOIN f USING (client_ip, server_ip, seq)) GROUP BY ALL")
def _feed(spark, sf_dir):
    s = SF.stream_score(packet_stream(spark, sf_dir), tail_profile(spark, sf_dir), reduce=last_features)
    path = scratch(spark, "feed")
    SF.stream_score_feed(s, scratch(spark, "feed-state"), path=path).awaitTermination()
    back = G.parse_event_message(spark.read.text(path).withColumnRenamed("value", "message"))
    return back.groupBy("point", "score").agg(F.count(F.lit(1)).alias("n"))


@query("stream_adapt_patterns", ORACLES["adapt_patterns"])
def _adapt(spark, sf_dir):
    p = packet_stream(spark, sf_dir).withColumn("code", F.when(F.col("msg_id") < 4, 0).otherwise(1))
    d = settled(spark, SF.stream_adapt_patterns(p, ["client_ip"], initial_range=7, initial_uniqueness=2), "adapt-stream")
    return d.select("client_ip", "seq", "held_range", "held_uniqueness")


IDLE_ADAPT_SQL = f"""WITH {flow_packets_sql()},
visits AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY client_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 5
  THEN 1 ELSE 0 END AS fresh FROM flow_packets),
numbered AS (SELECT client_ip, seq, msg_id, sum(fresh) OVER (PARTITION BY client_ip ORDER BY seq) AS visit FROM visits),
steps AS (SELECT *, row_number() OVER (PARTITION BY client_ip, visit ORDER BY seq) AS i FROM numbered)"""


# The pattern starts from the same values at every visit of a client: the fold is written out as a recursion.
@query("stream_adapt_idle", IDLE_ADAPT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
fold(client_ip, visit, i, seq, level, uniq) AS (
  SELECT client_ip, visit, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 7, 2 FROM steps WHERE i = 1
  UNION ALL SELECT s.client_ip, s.visit, s.i, s.seq, CASE WHEN msg_id >= 4 AND level >= 4 THEN level - 1 ELSE level END,
    CASE WHEN msg_id < 4 THEN (uniq | (uniq + 1)) % 4 WHEN level >= 4 THEN (uniq + 3) % 4 ELSE uniq END
  FROM fold f JOIN steps s ON s.client_ip = f.client_ip AND s.visit = f.visit AND s.i = f.i + 1)
SELECT client_ip, seq, level AS held_range, uniq AS held_uniqueness FROM fold WHERE i > 0""")
def _adapt_idle(spark, sf_dir):
    p = packet_stream(spark, sf_dir).withColumn("code", F.when(F.col("msg_id") < 4, 0).otherwise(1))
    d = settled(spark, SF.stream_adapt_patterns(p, ["client_ip"], initial_range=7, initial_uniqueness=2, idle_ms=5000), "adapt-idle")
    return d.select("client_ip", "seq", "held_range", "held_uniqueness")


@query("stream_domain_history", ORACLES["domain_history"])
def _history(spark, sf_dir):
    """The last update of each window; one input file is one micro-batch."""
    m = message_stream(spark, sf_dir)
    path = scratch(spark, "history")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (SE.stream_domain_history(m).writeStream.foreachBatch(save).outputMode("update")
         .option("checkpointLocation", scratch(spark, "history-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    cols = DQ.HISTORY_COLUMNS
    last = spark.read.parquet(path).groupBy("window_start", "domain_key").agg(F.max_by(F.struct("query_rate", *cols), "batch").alias("h"))
    return last.select((F.unix_seconds("window_start") - DAY).alias("win"), "domain_key", "h.query_rate",
                       *[F.round(f"h.{c}", 6).alias(c) for c in cols])


# A watermark closes only windows it has passed: the twin keeps those that end a minute before the last event.
@query("stream_event_counts", f"""WITH {HQ.EVENTS_SQL} SELECT win, code, name, round(s1, 6) AS s1, s4 FROM folded
WHERE code NOT IN ('click', 'view') OR win + 12 <= (SELECT max(event_id) - 60 FROM events)""")
def _counts(spark, sf_dir):
    e = HQ.host_events(spark, sf_dir, events=stream_table(spark, sf_dir, "events"))
    d = settled(spark, SE.stream_event_counts(e), "counts-stream")
    return HQ.slots(d, F.unix_seconds("window_start").alias("win"), "code", "name")


# Every 97th event comes 600 seconds late. Events arrive in five parts, each a micro-batch; what lies 30 seconds behind the
# newest time of the parts before is late.
LATE_SQL = """arrivals AS (SELECT event_id, event_id - CASE WHEN event_id % 97 = 5 THEN 600 ELSE 0 END AS t,
  event_id * 5 // (SELECT max(event_id) + 1 FROM events) AS part FROM events),
newest AS (SELECT part, max(max(t)) OVER (ORDER BY part) AS t FROM arrivals GROUP BY part),
told AS (SELECT a.*, coalesce(a.t < n.t - 30, false) AS late FROM arrivals a LEFT JOIN newest n ON n.part = a.part - 1)"""


def arrivals(spark, sf_dir):
    """The events as a stream of five micro-batches, in their order of arrival, with some times set back."""
    e = flow_packets(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.expr("seq - CASE WHEN seq % 97 = 5 THEN 600 ELSE 0 END")))
    n, path = e.agg(F.max("seq") + 1).first()[0], scratch(spark, "arrivals")
    for part in range(5):
        e.where(F.expr(f"seq * 5 div {n} = {part}")).repartition(2).write.parquet(f"{path}/part={part}")
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", max(1, files // 5)).parquet(path)


@query("late_policy", f"""WITH {LATE_SQL}, counts AS (SELECT t // 300 * 300 AS win, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS late
FROM told GROUP BY win) SELECT * FROM counts""")
def _late(spark, sf_dir):
    path = scratch(spark, "late")
    SE.split_late(arrivals(spark, sf_dir), path, scratch(spark, "late-state"), "30 seconds").awaitTermination()
    on_time, late = SE.read_split(spark, path)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy(F.expr("unix_seconds(ts) div 300 * 300").alias("win")).agg(
        F.count_if(~F.col("late")).alias("n"), F.count_if("late").alias("late"))


@query("late_rows", f"WITH {LATE_SQL} SELECT event_id AS seq, t, part AS batch FROM told WHERE late")
def _late_rows(spark, sf_dir):
    path = scratch(spark, "late")
    SE.split_late(arrivals(spark, sf_dir), path, scratch(spark, "late-state"), "30 seconds").awaitTermination()
    return SE.read_split(spark, path)[1].select("seq", F.unix_seconds("ts").alias("t"), F.col("batch").cast("long").alias("batch"))


# Bursts of a domain with pauses of five seconds. The watermark, a minute behind the newest message, closes the bursts before it.
PAUSE = "5 seconds"
BURSTS_SQL = f"""WITH {MESSAGES_SQL}, named AS (SELECT *, reverse(qname) AS rname FROM messages WHERE qname IS NOT NULL),
keyed AS (SELECT *, CASE WHEN length(rname) - length(replace(rname, '.', '')) >= 3 THEN array_to_string(string_split(rname, '.')[1:3], '.')
  ELSE rname END AS domain_key FROM named),
fresh AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY domain_key ORDER BY t) <= 5 THEN 0 ELSE 1 END AS fresh FROM keyed),
burst AS (SELECT *, sum(fresh) OVER (PARTITION BY domain_key ORDER BY t) AS burst FROM fresh),
bursts AS (SELECT min(t) AS start_t, max(t) + 5 AS end_t, domain_key, count(*) AS queries, CAST(sum(length(rname)) AS BIGINT) AS name_len
  FROM burst GROUP BY domain_key, burst)"""


@query("domain_sessions", f"{BURSTS_SQL} SELECT * FROM bursts")
def _sessions(spark, sf_dir):
    m = messages(spark, sf_dir).where("qname is not null")
    return SE.domain_sessions(m, PAUSE).select(F.unix_seconds("start").alias("start_t"), F.unix_seconds("end").alias("end_t"), "domain_key", "queries", "name_len")


@query("stream_domain_sessions", f"{BURSTS_SQL} SELECT * FROM bursts WHERE end_t <= (SELECT max(t) - 60 FROM keyed)")
def _stream_sessions(spark, sf_dir):
    m = message_stream(spark, sf_dir, replayed(spark, sf_dir, "events", "event_id"))
    d = settled(spark, SE.domain_sessions(m, PAUSE), "sessions-stream")
    return d.select((F.unix_seconds("start") - DAY).alias("start_t"), (F.unix_seconds("end") - DAY).alias("end_t"), "domain_key", "queries", "name_len")


# Queries and responses of a client with the same message id, five seconds apart at most.
MATCH_SQL = f"""WITH {flow_packets_sql()}, q AS (SELECT * FROM flow_packets WHERE direction = 'OUT'), r AS (SELECT * FROM flow_packets WHERE direction = 'IN'),
joined AS (SELECT coalesce(q.client_ip, r.client_ip) AS client_ip, q.seq AS query_seq, r.seq AS response_seq, coalesce(q.t, r.t) AS t
  FROM q FULL JOIN r ON q.client_ip = r.client_ip AND q.msg_id = r.msg_id AND r.t BETWEEN q.t AND q.t + 5)
SELECT client_ip, query_seq, response_seq, CASE WHEN response_seq IS NULL THEN 'unanswered' WHEN query_seq IS NULL THEN 'unasked' ELSE 'matched' END AS outcome
FROM joined"""
MATCHED = ("client_ip", "query_seq", "response_seq", "outcome")


def asked_and_answered(packets):
    return SE.match_answers(packets.where("direction = 'OUT'"), packets.where("direction = 'IN'"), ["client_ip", "msg_id"])


@query("match_answers", MATCH_SQL)
def _match(spark, sf_dir):
    return asked_and_answered(flow_packets(spark, sf_dir)).select(*MATCHED)


# What the watermark, ten seconds behind, has left open at the end of the stream is not given; the last half minute is not compared.
@query("stream_match_answers", MATCH_SQL + " WHERE t <= (SELECT max(event_id // 10) - 30 FROM events)")
def _stream_match(spark, sf_dir):
    d = settled(spark, asked_and_answered(packet_stream(spark, sf_dir)), "match-stream")
    last = flow_packets(spark, sf_dir).agg((F.max(F.unix_seconds("ts")) + DAY - 30).alias("last"))
    t = F.unix_seconds(F.coalesce("query_ts", "response_ts"))
    return d.join(F.broadcast(last), t <= F.col("last")).select(*MATCHED)


@query("stream_grow_profile", HQ.GROWN_SQL)
def _grow(spark, sf_dir):
    training, early = HQ.event_periods(spark, sf_dir)
    saved, out = scratch(spark, "profile"), scratch(spark, "grown")
    SE.save_profile(lead_event_profile(training, HQ.EVENT_RADIUS), saved, 0)
    e = HQ.host_events(spark, sf_dir, events=stream_table(spark, sf_dir, "events")).where(~early)
    SE.stream_grow_profile(e, saved, scratch(spark, "grow-state"), out, vec="vec", leaders=("ts", "seq")).awaitTermination()
    return HQ.grown_clusters(spark.read.parquet(out))


@query("stream_write_points", ORACLES["write_points"])
def _points(spark, sf_dir):
    f = SF.stream_flow_features(packet_stream(spark, sf_dir)).withColumn("tag", F.concat(F.lit("SCORE: "), F.col("seq").cast("string")))
    path = scratch(spark, "points")
    S.stream_write_points(f, path, scratch(spark, "points-state")).awaitTermination()
    back = S.read_points(spark, path)
    return back.select("tag", F.array_join(F.transform("features", lambda x: x.cast("long").cast("string")), ",").alias("point"))


# Pattern points are written by the same sink as feature points.
@query("write_pattern_points", ORACLES["pack_pattern"].replace("SELECT seq, array_to_string", "SELECT 'SCORE: ' || seq AS tag, array_to_string"))
def _pattern_points(spark, sf_dir):
    p = D.pack_pattern(DQ.patterns(spark, sf_dir)).withColumn("tag", F.concat(F.lit("SCORE: "), F.col("seq").cast("string")))
    path = scratch(spark, "pattern-points")
    S.write_pattern_points(p, path)
    back = S.read_points(spark, path)
    return back.select("tag", F.array_join(F.transform("features", lambda x: x.cast("long").cast("string")), ",").alias("point"))
