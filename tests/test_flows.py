import random

import pytest
from pyspark.sql import functions as F

from models import flow_vectors
from weir.operators import flows

SCHEMA = ("client_ip long, server_ip long, seq long, t long, direction string, len int, src_port int, "
          "dst_port int, msg_id int")


def make(spark, n=1500, flows_=3, ports=40, seed=1, hot=0.6):
    rng = random.Random(seed)
    rows, t = [], 1000
    for i in range(n):
        t += rng.choice([0, 0, 0, 1, 3])
        flow = 0 if rng.random() < hot else rng.randrange(flows_)
        rows.append((flow, 7, i, t, rng.choice(["OUT", "OUT", "IN"]), rng.choice([0, 60, 90, 512]),
                     1024 + rng.randrange(ports), 53, rng.randrange(5)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("ports,chunk_rows", [(40, None), (90, None), (40, 100), (90, 70)])
def test_features_match_the_ring_model(spark, ports, chunk_rows):
    rows, df = make(spark, ports=ports)
    want = flow_vectors(((r[0], r[1]), r[2], r[4], r[3], r[5], r[6]) for r in rows)
    got = {((r.client_ip, r.server_ip), r.seq): [int(x) for x in r.features]
           for r in flows.flow_features(df, chunk_rows).collect()}
    assert got.keys() == want.keys()
    bad = {k: [(flows.FEATURES[i], a, b) for i, (a, b) in enumerate(zip(got[k], want[k])) if a != b]
           for k in want if got[k] != want[k]}
    assert not bad, list(bad.items())[:3]


SINGLE = ["rtt_stats", "query_rate_stats", "byte_rate_stats", "inter_query_stats", "updown_ratio_stats",
          "inflight_packet_stats", "inflight_byte_stats", "forward_length_stats", "backward_length_stats",
          "running_port_reuse", "source_pattern", "match_previous", "asof_last_query", "asof_last_response"]


@pytest.mark.parametrize("name", SINGLE)
def test_chunked_equals_plain(spark, name):
    _, df = make(spark, ports=70)
    fn = getattr(flows, name)
    plain, cut = fn(df, chunk_rows=None), fn(df, chunk_rows=90)
    assert sorted(plain.columns) == sorted(cut.columns)
    cols = sorted(plain.columns)
    a = sorted(map(str, plain.select(cols).collect()))
    b = sorted(map(str, cut.select(cols).collect()))
    assert a and a == b


def test_final_port_state_is_the_last_running_state(spark):
    _, df = make(spark, ports=120)
    running = flows.running_port_reuse(df)
    last = running.groupBy(*flows.FLOW).agg(F.max_by(F.struct("port_reuse_mean", "port_reuse_std"), "seq").alias("s"))
    a = {(r.client_ip, r.s.port_reuse_mean, r.s.port_reuse_std) for r in last.collect()}
    b = {(r.client_ip, r.port_reuse_mean, r.port_reuse_std) for r in flows.port_reuse(df).collect()}
    assert a == b


def test_one_exchange_on_packets(spark):
    _, df = make(spark)
    plan = flows.flow_features(df, None)._jdf.queryExecution().executedPlan().toString()
    # one for the packets; the others belong to the table of retired ports
    assert plan.count("Exchange hashpartitioning(client_ip") <= 5, plan
