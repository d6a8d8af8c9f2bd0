import pytest
from pyspark.sql import functions as F

from weir.operators import hostevents as H
from weir.sources import configs, samples, sockets
from weir.streaming.flows import advance


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_ragged_files_and_refusal(spark, tmp_path):
    normal, odd = tmp_path / "normal", tmp_path / "anomalous"
    normal.mkdir(), odd.mkdir()
    (normal / "a.csv").write_text("1, 2, 3, SCORE: 1\n4, 5, SCORE: 1\n7, 8, 9, x\n")
    (normal / "b.csv").write_text("1, 2, t\n3, 4, t\n")
    (odd / "c.csv").write_text("1, 2, t\n1, 2, 3, t\n")
    (normal / "skip.txt").write_text("1, 2\n")
    train, test = samples.load_samples(spark, str(tmp_path))
    assert sorted(map(tuple, (r.features for r in train.collect()))) == [(1, 2), (1, 2, 3), (3, 4), (7, 8, 9)]
    assert [(r.source, r.features) for r in test.where("label = 'N'").collect()] == [("c.csv", [1, 2])]
    samples.import_samples(train, str(tmp_path), "normal", "new")
    with pytest.raises(Exception, match="(?i)exists"):
        samples.import_samples(train, str(tmp_path), "normal", "new")


def test_line_order(spark, tmp_path):
    (tmp_path / "normal").mkdir()
    (tmp_path / "normal" / "a.csv").write_text("".join(f"{i}, t\n" for i in range(200)))
    from weir.operators.vectors import systematic_sample

    df = samples.load_tagged(spark, str(tmp_path / "normal"), "P")
    got = systematic_sample(df, *samples.LINE_ORDER, step=10)
    assert sorted(r.features[0] for r in got.collect()) == [float(i) for i in range(0, 200, 10)]


def test_socket_line(spark):
    r = sockets.parse_socket_snapshot(lines(
        spark, "Proto Recv-Q ...", "tcp     0    0 localhost:domain     *:*      LISTEN      root    8801     -",
        "tcp6       0      0 :::22     :::*    LISTEN   0   1  9/sshd: user")).collect()
    assert (r[0].local_address, r[0].local_port, r[0].foreign_port, r[0].state, r[0].program) == ("localhost", "domain", "*", "LISTEN", "")
    assert (r[1].local_address, r[1].local_port, r[1].pid) == ("::", "22", "9")


def test_bad_arguments(spark):
    df = lines(spark, "x")
    with pytest.raises(ValueError):
        sockets.parse_socket_snapshot(df, "solaris")
    with pytest.raises(ValueError):
        sockets.select_field(df, "nothing")
    with pytest.raises(ValueError):
        H.top_processes(df, "colour")
    with pytest.raises(ValueError):
        H.event_vector(F.lit("a"), {5: F.lit(1)})


def test_ip_numbers(spark):
    df = lines(spark, "10.0.0.1", "300.1.1.1", "x", "1.2.3").select(configs.ip_number(F.col("value")).alias("n"))
    assert [r.n for r in df.collect()] == [167772161, None, None, None]


def test_unknown_action_class_fails(spark):
    with pytest.raises(Exception, match="unknown class"):
        lines(spark, "/etc/x").select(H.path_sensitivity(F.col("value"), F.lit("lock"))).collect()


def test_state_steps_match_one_pass():
    """A flow fed in pieces gives the features of the flow fed at once, and those of the ring model."""
    import random

    import pandas as pd
    from models import flow_vectors

    rng = random.Random(9)
    t, rows = 100, []
    for i in range(900):
        t += rng.choice([0, 0, 1, 4])
        rows.append((i, t, rng.choice(["OUT", "IN"]), rng.choice([0, 80, 300]), rng.randrange(1024, 1124)))
    pdf = pd.DataFrame(rows, columns=["seq", "t", "direction", "len", "src_port"])
    whole, _ = advance(None, pdf)
    state, parts = None, []
    for start in range(0, 900, 37):
        f, state = advance(state, pdf.iloc[start: start + 37].reset_index(drop=True))
        parts += f.tolist()
    want = flow_vectors(((0,), s, d, t, n, p) for s, t, d, n, p in rows)
    assert whole.tolist() == parts == [want[(0,), i] for i in range(900)]


def test_datagram_lines_with_and_without_a_state(spark):
    got = sockets.parse_socket_snapshot(lines(
        spark, "udp6 0 0 :::5353 :::* 107 21344 812/avahi", "udp 0 0 10.0.0.1:68 10.0.0.2:67 ESTABLISHED 0 555 9/dhc",
        "tcp6 0 0 :::22 :::* LISTEN 0 77 1/sshd"), "linux")
    rows = [tuple(r) for r in got.select("state", "user", "inode", "program").collect()]
    assert rows == [("", "107", "21344", "avahi"), ("ESTABLISHED", "0", "555", "dhc"), ("LISTEN", "0", "77", "sshd")]
