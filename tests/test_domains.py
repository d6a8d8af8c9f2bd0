import random

import pytest
from pyspark.sql import functions as F

from weir.operators import domains as D


def fold(names):
    """The history of one domain in one window, name by name."""
    n, avg, ln, rate, vq, vl, vn = 0, 1.0, None, None, 100.0, 100.0, 100.0
    for name in names:
        n += 1
        size = float(len(name))
        odd = 1 + sum(not (c.islower() or c == ".") for c in name[:-1])
        share = odd / size
        ln, rate = (size, share) if n == 1 else (ln, rate)
        avg = (avg + n) / 2
        vq = (vq + 1 + abs(avg - n) / (1 + avg)) / 2
        ln = (ln + size) / 2
        vl = (vl + 1 + abs(ln - size) / (1 + ln)) / 2
        if odd > 1:
            rate = (rate + share) / 2
            vn = (rate + 1 + abs(rate - share) / (1 + rate)) / 2
    return n, avg, ln, rate, vq, vl, vn


@pytest.mark.parametrize("digits", [0.0, 0.02, 0.5])
def test_history_of_a_hot_domain(spark, digits):
    """Far more names than the tail that is kept; few or many of them coded."""
    rng = random.Random(5)
    names = []
    for i in range(700):
        label = "x" * rng.randrange(1, 9) + (str(i) if rng.random() < digits else "")
        names.append(f"{label}.example.com.")
    df = spark.createDataFrame([(i, i % 300, n) for i, n in enumerate(names)], "seq long, t long, qname string").withColumn(
        "ts", F.timestamp_seconds("t"))
    r = D.domain_history(df).collect()
    assert len(r) == 1 and r[0].domain_key == ".moc.elpmaxe"
    got = (r[0].query_rate, r[0].query_avg_rate, r[0].len_avg, r[0].nonlc_avg_rate, r[0].query_rate_variation,
           r[0].len_variation, r[0].nonlc_rate_variation)
    assert got == pytest.approx(fold([n[::-1] for n in names]), rel=1e-12)


@pytest.mark.parametrize("chunk_rows", [None, 150])
def test_recurrences(spark, chunk_rows):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else 1, i, rng.uniform(0, 100), rng.choice([0, 0, 1])) for i in range(1400)]
    df = spark.createDataFrame(rows, "k long, seq long, x double, code int")
    state, want = {}, {}
    for k, i, x, c in rows:
        a, level, u = state.get(k, (5.0, 7, 1))
        a += 0.15 * (x - a)
        if c == 0:
            u = (u | (u + 1)) % 4
        elif level >= 4:
            level, u = level - 1, (u - 1) % 4
        state[k] = a, level, u
        want[i] = a, level, u
    e = {r.seq: r.ewma for r in D.ewma(df, "x", 0.15, ["k"], "seq", 5.0, chunk_rows=chunk_rows).collect()}
    assert e == pytest.approx({i: w[0] for i, w in want.items()}, rel=1e-9)
    h = {r.seq: (r.held_range, r.held_uniqueness) for r in D.adapt_patterns(
        df, ["k"], "seq", initial_range=7, initial_uniqueness=1, chunk_rows=chunk_rows).collect()}
    assert h == {i: w[1:] for i, w in want.items()}


def test_domain_keys(spark):
    names = {"www.example.com.": ".moc.elpmaxe", "com.": ".moc", "nodots": "stodon", "a.b.c.d.": ".d.c"}
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    assert {r.qname: r.domain_key for r in D.with_domain_key(df).collect()} == names


@pytest.mark.parametrize("chunk_rows", [None, 3])
@pytest.mark.parametrize("alpha", [0.5, 0.97, 1.0])
def test_ewma_skips_nulls_and_takes_the_last_value_at_one(spark, alpha, chunk_rows):
    x = [None, 10.0, None, 20.0, 7.0, None, None, 3.0] * 5
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, seq long, x double")
    got = {r.seq: r.ewma for r in D.ewma(df, "x", alpha, ["k"], "seq", 5.0, chunk_rows=chunk_rows).collect()}
    a, want = 5.0, {}
    for i, v in enumerate(x):
        a += alpha * (v - a) if v is not None else 0
        want[i] = a
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        D.ewma(df, "x", 0.0, ["k"], "seq")
