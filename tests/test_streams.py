"""State that ends by event time, late rows and matched queries over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from weir.operators.flows import FEATURES, flow_features
from weir.plans.bindings import replayed
from weir.streaming import events as SE
from weir.streaming import flows as SF

PACKET = "seq long, ts timestamp, direction string, client_ip long, server_ip long, src_port int, dst_port int, len int, msg_id int"


def feed(spark, path, batches, schema=PACKET):
    """A stream of one file a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, path, mode="append"):
    q = (df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def packet(seq, t, client=1, out=True, length=60, port=None):
    import datetime as dt

    ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
    port = 2000 + seq % 7 if port is None else port
    return (seq, ts, "OUT" if out else "IN", client, 0, port if out else 53, 53 if out else port, length, seq % 3)


def visits():
    """Three clients; one pauses for over a minute within a batch, one between batches, one never."""
    rows, seq = [[], [], [], []], 0
    for t in range(0, 1200, 4):
        for client, quiet in ((1, lambda t: 100 < t < 200 or 700 < t < 900), (2, lambda t: 250 < t < 650), (3, lambda t: False)):
            if not quiet(t):
                rows[t // 300].append(packet(seq, t, client, seq % 3 != 1, 40 + seq * 7 % 50))
                seq += 1
    return rows


def test_an_idle_flow_starts_afresh_and_its_state_goes(spark, tmp_path):
    batches = visits()
    q = run(SF.stream_flow_features(feed(spark, f"{tmp_path}/in", batches), idle_ms=60_000, watermark="10 seconds"), tmp_path)
    got = {r.seq: [int(x) for x in r.features] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    flat, last, visit, keyed = [r for b in batches for r in b], {}, {}, []
    for r in flat:
        t, c = r[1], r[3]
        visit[c] = visit.get(c, 0) + (c in last and (t - last[c]).total_seconds() > 60)
        last[c] = t
        keyed.append((*r[:3], c + 1000 * visit[c], *r[4:]))
    whole = flow_features(spark.createDataFrame(keyed, PACKET))
    want = {r.seq: [int(r[c] or 0) for c in FEATURES] for r in whole.collect()}
    assert max(visit.values()) == 2 and got == want
    states = [p["stateOperators"][0] for p in map(lambda p: p if isinstance(p, dict) else p.jsonValue if hasattr(p, "jsonValue") else p, q.recentProgress)]
    assert max(s["numRowsTotal"] for s in states) >= 3


def test_state_of_gone_keys_is_freed(spark, tmp_path):
    """A client is seen once a batch and never again: its state is freed when the watermark has passed its pause."""
    batches = [[packet(10 * b + i, 1000 * b + i, client=b) for i in range(5)] for b in range(6)]
    q = run(SF.stream_adapt_patterns(feed(spark, f"{tmp_path}/in", batches).withColumn("code", F.lit(1)), ["client_ip"], initial_range=7,
                                     idle_ms=30_000, watermark="10 seconds"), tmp_path)
    held = [r for p in q.recentProgress for o in p["stateOperators"] for r in [o["numRowsTotal"]]]
    # a key has a row of state and two of its timer; six keys would have eighteen
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30 and held[-1] <= 9


def test_visits_of_any_batches():
    import numpy as np

    t = np.array([0, 5, 3, 40, 41, 101, 102])
    assert SF._visits(t, None, 30) == [(0, 3, True), (3, 5, True), (5, 7, True)]
    assert SF._visits(t, 10, 35) == [(0, 5, False), (5, 7, True)]
    assert SF._visits(t, -100, 30)[0] == (0, 3, True) and SF._visits(np.array([7]), 7, 0) == [(0, 1, False)]


def test_late_rows_are_a_table(spark, tmp_path):
    batches = [[packet(0, 100), packet(1, 50)], [packet(2, 60), packet(3, 89), packet(4, 90), packet(5, 300)], [packet(6, 269), packet(7, 270)], []]
    SE.split_late(feed(spark, f"{tmp_path}/in", batches), f"{tmp_path}/split", f"{tmp_path}/state", "30 seconds").awaitTermination()
    on_time, late = SE.read_split(spark, f"{tmp_path}/split")
    assert sorted(r.seq for r in late.collect()) == [2, 6]
    assert sorted(r.seq for r in on_time.collect()) == [0, 1, 3, 4, 5, 7] and late.where("watermark IS NULL").count() == 0


@pytest.mark.parametrize("streaming", [False, True])
def test_queries_and_their_responses(spark, tmp_path, streaming):
    rows = [packet(0, 0), packet(3, 2, out=False), packet(6, 20), packet(9, 31, out=False), packet(1, 40), packet(4, 45, out=False),
            packet(7, 45, out=False), packet(2, 300, client=9), packet(5, 900, client=8), packet(8, 905, client=8, out=False)]
    df = feed(spark, f"{tmp_path}/in", [rows[:4], rows[4:7], rows[7:8], rows[8:]]) if streaming else spark.createDataFrame(rows, PACKET)
    joined = SE.match_answers(df.where("direction = 'OUT'"), df.where("direction = 'IN'"), ["client_ip", "msg_id"])
    if streaming:
        run(joined, tmp_path)
        joined = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.query_seq, r.response_seq, r.outcome) for r in joined.collect()}
    want = {(0, 3, "matched"), (6, None, "unanswered"), (None, 9, "unasked"), (1, 4, "matched"), (1, 7, "matched"), (2, None, "unanswered"), (5, 8, "matched")}
    assert got == want


def test_bursts_of_a_domain(spark, tmp_path):
    schema = "seq long, ts timestamp, client_ip long, qname string"
    rows = [(i, packet(i, t)[1], 1, f"a{i}.site.org.") for i, t in enumerate([0, 10, 20, 51, 52, 400, 1000])]
    stream = feed(spark, f"{tmp_path}/in", [rows[:3], rows[3:5], rows[5:]], schema)
    run(SE.domain_sessions(stream, "30 seconds", "10 seconds"), tmp_path)
    got = sorted((r.queries, (r.end - r.start).total_seconds()) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 30.0), (2, 31.0), (3, 50.0)]
    whole = SE.domain_sessions(spark.createDataFrame(rows, schema), "30 seconds")
    assert sorted(r.queries for r in whole.collect()) == [1, 1, 2, 3]


def test_a_table_is_replayed_in_order_by_bounded_batches(spark, sf, tmp_path):
    seen = []

    def take(batch, number):
        seen.append(sorted(r.event_id for r in batch.select("event_id").collect()))

    events = replayed(spark, sf, "events", "event_id", rows=300)
    events.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    every = [r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").orderBy("event_id").collect()]
    assert [i for part in seen for i in part] == every and len(seen) > 2 and max(map(len, seen)) < 400


def test_a_table_of_queries_meets_responses_of_near_slots_only(spark):
    rows = [packet(i, i // 2 * 1.25, client=i % 3, out=i * 7 % 5 < 3) for i in range(400)]
    df = spark.createDataFrame([*rows, rows[0]], PACKET)
    got = SE.match_answers(df.where("direction = 'OUT'"), df.where("direction = 'IN'"), ["client_ip"])
    assert "_q_slot" in got._jdf.queryExecution().optimizedPlan().toString()
    asked, answers = ([r for r in [*rows, rows[0]] if r[2] == way] for way in ("OUT", "IN"))
    met = lambda q, r: q[3] == r[3] and 0 <= (r[1] - q[1]).total_seconds() <= 5
    want = [(q[0], r[0], "matched") for q in asked for r in answers if met(q, r)]
    want += [(q[0], None, "unanswered") for q in asked if not any(met(q, r) for r in answers)]
    want += [(None, r[0], "unasked") for r in answers if not any(met(q, r) for q in asked)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.query_seq, r.response_seq, r.outcome) for r in got.collect()), key=key) == sorted(want, key=key)


def test_a_stream_of_queries_meets_responses_of_near_slots_only(spark, tmp_path):
    import random

    r = random.Random(4)
    times = sorted([r.choice([80 * r.randrange(1, 9) + r.choice([-5, 0, 5]), r.randrange(60, 700) / 2]) for _ in range(400)])
    rows = [packet(i, t, client=r.choice([0, 1, 2]), out=r.random() < 0.4) for i, t in enumerate(times)]
    end = [packet(1000, 5000, client=7), packet(1001, 9000, client=7), packet(1002, 9000, client=7, out=False)]
    df = feed(spark, f"{tmp_path}/in", [rows[:150], rows[150:152], rows[152:], end[:1], end[1:]])
    got = SE.match_answers(df.where("direction = 'OUT'"), df.where("direction = 'IN'"), ["client_ip"])
    assert "_q_slot" in got._jdf.queryExecution().analyzed().toString()
    run(got, tmp_path)
    asked, answers = ([x for x in rows if x[2] == way] for way in ("OUT", "IN"))
    met = lambda q, a: q[3] == a[3] and 0 <= (a[1] - q[1]).total_seconds() <= 5
    want = [(q[0], a[0], "matched") for q in asked for a in answers if met(q, a)]
    want += [(q[0], None, "unanswered") for q in asked if not any(met(q, a) for a in answers)]
    want += [(None, a[0], "unasked") for a in answers if not any(met(q, a) for q in asked)]
    found = [(x.query_seq, x.response_seq, x.outcome) for x in spark.read.parquet(f"{tmp_path}/out").where("client_ip < 7").collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_history_state_takes_two_calls_a_window():
    """A window's rows may come in several frames and any order; its state is read once and written once, and has one timer."""
    import pandas as pd
    from weir.streaming.events import _HistoryProcessor

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        held, timers = Held(), []

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, at):
            self.timers.append(at)

    def frames(rows):
        return iter([pd.DataFrame(rows[i:i + 3], columns=["seq", "name_len", "nonlc"]) for i in range(0, len(rows), 3)])

    rows = [(7, 12, 2), (1, 20, 0), (5, 9, 3), (3, 31, 1), (2, 8, 4)]
    key, out = (pd.Timestamp("2020-01-01"), "com.example"), []
    for parts in ([sorted(rows)], [rows], [sorted(rows)[:2], sorted(rows)[2:]]):
        p = _HistoryProcessor(300_000)
        Handle.held, Handle.timers = Held(), []
        p.init(Handle())
        for part in parts:
            got = list(p.handleInputRows(key, frames(part), None))
        out.append(got[0].iloc[0].tolist())
        assert Handle.held.calls == 2 * len(parts) and Handle.timers == [1577836800_000 + 300_000]
    assert out[0] == out[1] == out[2] and out[0][2] == 5
