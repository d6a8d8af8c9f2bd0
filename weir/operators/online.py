"""Online linear classifiers, fitted over all trials of a comparison at once by mixing the weights of shards.

An epoch is one pass: every shard takes the weights of the epoch before, goes through its rows one by one as an online solver
does, and the weights of the shards are averaged by their rows. Shards hold a bounded number of rows, chosen and ordered by a
hash of the row, so that the result does not hang on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.evaluate import _summed
from weir.operators.metric import vectors_of, written
from weir.operators.vectors import HELD_OUT, ROUNDS, column_stats, common_width, filter_dimension, hashed_share

SOLVERS = ("sgd", "asgd", "perceptron", "passive_aggressive_1", "passive_aggressive_2")
SHARD_ROWS = 4096
# Fixed values of the comparison: aggressiveness of the passive-aggressive solvers, penalty of the gradient solvers.
C, ALPHA = 1.0, 1e-4


def _steps(w: np.ndarray, x: np.ndarray, sign: float, train: np.ndarray, t: np.ndarray) -> None:
    """One row through every solver and trial: `w` is (solver, feature, trial), `t` the rows each trial has seen."""
    square, margin = float(x @ x), sign * np.einsum("f,sft->st", x, w)
    rate = 1.0 / (1.0 + ALPHA * t)
    w[0] *= np.where(train, 1.0 - rate * ALPHA, 1.0)
    loss = np.maximum(0.0, 1.0 - margin)
    move = np.stack([
        np.where(margin[0] < 1, rate, 0.0), np.zeros_like(rate), (margin[2] <= 0).astype(float),
        np.minimum(C, loss[3] / square), loss[4] / (square + 0.5 / C)]) * train
    w += x[None, :, None] * (sign * move)[:, None, :]


def pass_over(w: np.ndarray, x: np.ndarray, y: np.ndarray, train: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights after the rows one by one; the averaged solver's are the mean of the gradient solver's over the rows."""
    w, t, total = w.copy(), seen.astype(float).copy(), np.zeros_like(w[0])
    for i in range(len(x)):
        _steps(w, x[i], 1.0 if y[i] else -1.0, train[i], t)
        t += train[i]
        total += w[0] * train[i]
    rows = train.sum(0)
    w[1] = np.where(rows, total / np.maximum(rows, 1), w[0])
    return w


def online_trials(samples: DataFrame, fractions: Sequence[float] = HELD_OUT, rounds: int = ROUNDS, epochs: int = 5, seed: int = 42,
                  row_id: str = "row_id", vec: str = "features", share=hashed_share, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Held-out rows and errors of the online solvers, one line per (classifier, fraction, round).

    `sgd` and `asgd` take the hinge loss, `asgd` with averaged weights; features are standardised and have a constant. A
    trial's training rows are those whose share is not below the fraction. Vectors of another than the commonest width are
    left out. Passes do not grow with the number of trials; weights (solvers, features, trials) are all that reaches the driver.
    """
    spark, dim = samples.sparkSession, common_width(samples, vec)
    data = filter_dimension(samples, dim, vec)
    stats = sorted(column_stats(data, vec).collect(), key=lambda r: r.pos)
    mean, std = np.array([r["mean"] for r in stats]), np.array([r["std"] or 1.0 for r in stats])
    shares = F.array(*[share(F.col(row_id), F.lit(r), seed).cast("double") for r in range(rounds)])
    trials = [(f, r) for f in fractions for r in range(rounds)]
    cuts, at = np.array([f for f, _ in trials]), np.array([r for _, r in trials])
    shards = max(1, -(-data.count() // shard_rows))
    order = F.xxhash64(F.col(row_id), F.col(vec), F.lit(seed))
    rows = data.select(F.col(vec).cast("array<double>").alias("x"), (F.col("label") == "P").cast("int").alias("y"), shares.alias("s"),
                       order.alias("h"), F.pmod(order, F.lit(shards)).alias("shard"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("h").combine_chunks()
        x, _ = vectors_of(table["x"].chunk(0), dim)
        held, _ = vectors_of(table["s"].chunk(0), rounds)
        return pa.table({"x": [x.tobytes()], "y": [table["y"].to_numpy().astype(np.int8).tobytes()], "s": [held.tobytes()]})

    packed = written(rows.groupBy("shard").applyInArrow(pack, "x binary, y binary, s binary"), "shards")

    def shards_of(batches):
        for batch in batches:
            for x, y, s in zip(*(c.to_pylist() for c in batch.columns)):
                x = (np.frombuffer(x).reshape(-1, dim) - mean) / std
                yield np.hstack((x, np.ones((len(x), 1)))), np.frombuffer(y, np.int8), np.frombuffer(s).reshape(-1, rounds)[:, at] < cuts

    shape = (len(SOLVERS), dim + 1, len(trials))
    size = int(np.prod(shape))

    def epoch(weights, seen):
        shared = spark.sparkContext.broadcast((weights, seen))

        def run(batches):
            start, before = shared.value
            total, n = np.zeros(shape), np.zeros(shape[2])
            for x, y, held in shards_of(batches):
                rows = (~held).sum(0)
                total += pass_over(start, x, y, ~held, before) * rows
                n += rows
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((total.ravel(), n)).tobytes()], pa.binary())], names=["x"])

        found = _summed(packed.mapInArrow(run, "x binary"), size + shape[2])
        n = found[size:]
        return np.where(n, found[:size].reshape(shape) / np.maximum(n, 1), weights), n

    w, seen = np.zeros(shape), np.zeros(shape[2])
    averaged, told = np.zeros(shape[1:]), 0
    for _ in range(epochs):
        w, n = epoch(w, seen)
        averaged, told, seen = averaged + w[1], told + 1, seen + n / shards
    w[1] = averaged / max(1, told)
    final = spark.sparkContext.broadcast(w)

    def errors(batches):
        total = np.zeros((len(SOLVERS) + 1, shape[2]))
        for x, y, held in shards_of(batches):
            for i in range(len(SOLVERS)):
                total[i] += ((((x @ final.value[i]) > 0) != (y[:, None] > 0)) & held).sum(0)
            total[-1] += held.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    total = _summed(packed.mapInArrow(errors, "x binary"), (len(SOLVERS) + 1) * shape[2]).reshape(-1, shape[2])
    table = [(name, float(f), r, int(total[-1, k]), int(total[i, k])) for i, name in enumerate(SOLVERS) for k, (f, r) in enumerate(trials)]
    return spark.createDataFrame(table, "classifier string, fraction double, round int, held_out long, errors long")
