import random

import pytest
from pyspark.sql import functions as F

from weir.operators import flows
from weir.plans.ordering import with_position
from weir.plans.skew import Chunked


def test_position(spark):
    values = list(range(5000))
    random.Random(4).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, g long").repartition(6)
    got = with_position(df, "g", "v").orderBy("g", "v").collect()
    assert [r.pos for r in got] == list(range(5000))


def test_bursts_are_cut_again(spark):
    """A flow whose rows crowd into a small part of its range still gets chunks near the target."""
    seqs = list(range(4000)) + [10_000_000 + i for i in range(100)]
    df = spark.createDataFrame([(1, s) for s in seqs], "k long, seq long")
    k = Chunked(df, ["k"], "seq", 500)
    sizes = k.df.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo")).orderBy("_chunk").collect()
    assert max(r.n for r in sizes) <= 4 * 500
    assert [r.lo for r in sizes] == sorted(r.lo for r in sizes)


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, i, float(i % 13)) for i in range(400)], "k long, seq long, x double")
    plain = flows.moving_stats(df, "x", ["k"], "seq", chunk_rows=None)
    cut = flows.moving_stats(df, "x", ["k"], "seq", chunk_rows=60)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(plain.columns).collect()))


def test_pruned_scans(spark, sf):
    from weir.plans.catalog import QUERIES, load_all

    load_all()
    plan = QUERIES["flow_totals"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan
    assert "props" not in plan


def test_columns_survive(spark):
    df = spark.createDataFrame([(1, 2, 0, "OUT", 10, 5, 53, 1)],
                               "client_ip long, server_ip long, seq long, direction string, len int, src_port int, dst_port int, msg_id int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(5)))
    out = flows.flow_features(df)
    assert out.columns == [*df.columns, *flows.FEATURES, "features"]
    assert flows.source_pattern(df).columns == [*df.columns, "transactions", "port_repeats", "id_repeats", "source_code"]


@pytest.mark.parametrize("unit,want", [("seconds", 2), ("millis", 2500)])
def test_units(spark, unit, want):
    rows = [(1, 2, 0, "OUT", "2024-01-01 00:00:00.900"), (1, 2, 1, "IN", "2024-01-01 00:00:03.400")]
    df = spark.createDataFrame(rows, "client_ip long, server_ip long, seq long, direction string, t string").withColumn(
        "ts", F.to_timestamp("t")).drop("t")
    got = flows.asof_last_query(df, unit).first().since_last_query
    assert got == (want if unit == "millis" else 3)
