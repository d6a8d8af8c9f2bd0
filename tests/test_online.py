"""Online solvers against loops over single rows, and the kernel mean against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import online as O
from weir.operators import profiles as P


def plain(solver, x, y, epochs=1):
    """One trial of one solver, row by row."""
    w, total, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(epochs):
        for row, sign in zip(x, np.where(y, 1.0, -1.0)):
            margin, square = sign * (w @ row), row @ row
            if solver in ("sgd", "asgd"):
                rate = 1 / (1 + O.ALPHA * t)
                w = w * (1 - rate * O.ALPHA) + (rate * sign * row if margin < 1 else 0)
            elif solver == "perceptron":
                w = w + (sign * row if margin <= 0 else 0)
            elif solver == "passive_aggressive_1":
                w = w + sign * row * min(O.C, max(0, 1 - margin) / square)
            else:
                w = w + sign * row * max(0, 1 - margin) / (square + 1 / (2 * O.C))
            t, total = t + 1, total + w
    return total / t if solver == "asgd" else w


def test_a_pass_equals_the_solvers_row_by_row():
    r = np.random.default_rng(3)
    x, y = np.hstack((r.normal(size=(60, 4)), np.ones((60, 1)))), r.random(60) < 0.4
    train = np.stack([np.ones(60, bool), np.arange(60) % 3 > 0, np.zeros(60, bool)], axis=1)
    got = O.pass_over(np.zeros((len(O.SOLVERS), 5, 3)), x, y, train, np.zeros(3))
    for i, solver in enumerate(O.SOLVERS):
        for k in range(2):
            assert got[i, :, k] == pytest.approx(plain(solver, x[train[:, k]], y[train[:, k]]), abs=1e-9)
        assert not got[i, :, 2].any()


@pytest.mark.parametrize("shard_rows", [4096, 50])
def test_separable_rows_are_told_apart(spark, shard_rows):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6))
    x = x[np.abs(x[:, 0] - x[:, 1]) > 1.0]
    rows = [(i, [float(a) for a in v], "P" if v[0] > v[1] else "N") for i, v in enumerate(x)] + [(9999, [1.0], "P")]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label string")
    out = O.online_trials(df, fractions=(0.5, 0.1), rounds=3, shard_rows=shard_rows).collect()
    assert len(out) == len(O.SOLVERS) * 6 and all(r.held_out > 0 for r in out)
    wrong = {s: sum(r.errors for r in out if r.classifier == s) / sum(r.held_out for r in out if r.classifier == s) for s in O.SOLVERS}
    assert max(wrong.values()) < 0.06, wrong


def test_the_trials_do_not_hang_on_partitions(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(a) for a in v], "P" if v.sum() > 0 else "N") for i, v in enumerate(r.normal(size=(80, 3)))]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label string")
    a, b = (sorted(map(tuple, O.online_trials(d, (0.5,), 2, epochs=2, shard_rows=30).collect())) for d in (df.repartition(1), df.repartition(5)))
    assert a == b


def test_kernel_mean_ranks_as_the_exact_one(spark):
    r = np.random.default_rng(6)
    x = np.vstack((r.normal(size=(150, 5)), 3 + r.normal(size=(60, 5))))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "row_id long, features array<double>")
    model = P.fit_kernel_mean(df.where("row_id < 150"), nu=0.1, gamma=0.1, size=2048)
    got = {r.row_id: r for r in model.score(df).collect()}
    exact = np.exp(-0.1 * ((x[:, None] - x[None, :150]) ** 2).sum(-1)).mean(1)
    own = np.array([got[i].kernel_mean for i in range(len(x))])
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(own), rank(exact))[0, 1] >= 0.95 and np.abs(own - exact).max() < 0.1
    inside = [got[i].predicted == "P" for i in range(150)]
    assert 130 <= sum(inside) <= 140 and got[999].kernel_mean is None
    assert df.where("row_id < 0").count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        P.fit_kernel_mean(df.where("row_id < 0"))
