"""Evaluation of profiles on labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.vectors import last_features
from weir.operators import profiles as P
from weir.operators.vectors import HELD_OUT, ROUNDS, column_stats, common_width, filter_dimension, hashed_share, systematic_sample
from weir.sources.samples import LINE_ORDER, load_samples


def evaluate(scored: DataFrame) -> DataFrame:
    """Errors and recall of the normal and the anomalous class, balanced recall and overall error. One row."""
    normal = F.col("label") == "P"
    said = F.col("predicted") == "P"

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    counts = scored.agg(n(normal).alias("pos_total"), n(normal & ~said).alias("pos_errors"),
                        n(~normal).alias("neg_total"), n(~normal & said).alias("neg_errors"))

    def share(a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))

    pt, pe, nt, ne = (F.col(c) for c in ("pos_total", "pos_errors", "neg_total", "neg_errors"))
    return counts.withColumns({
        "pos_recall": share(pt - pe, pt), "neg_recall": share(nt - ne, nt),
    }).withColumns({
        "recall": 0.5 * (F.col("pos_recall") + F.col("neg_recall")),
        "pos_error_pct": F.round(100 * share(pe, pt), 2), "neg_error_pct": F.round(100 * share(ne, nt), 2),
        "error_pct": F.round(100 * share(pe + ne, pt + nt), 2),
    })


def train_and_evaluate(spark: SparkSession, model_dir: str, method: str = "hier", reduce: str = "last10",
                       step: int = 10) -> DataFrame:
    """Load samples, thin the training set, reduce vectors, fit a profile and evaluate it on all samples."""
    train, test = load_samples(spark, model_dir)
    thin = systematic_sample(train, *LINE_ORDER, step=step)
    return fit_and_evaluate(thin, test, method, reduce)


def fit_and_evaluate(train: DataFrame, test: DataFrame, method: str = "hier", reduce: str = "last10") -> DataFrame:
    if reduce == "last10":
        def cut(df):
            return df.withColumn("features", last_features(F.col("features"), 10))
    elif reduce == "pca":
        pca = P.fit_pca(train.select("features").unionByName(test.select("features")))

        def cut(df):
            return P.project(df, pca, name="features")
    else:
        raise ValueError("reduce must be 'last10' or 'pca'")
    train, test = cut(train), cut(test)
    model = P.fit_one_class(train) if method == "one_class" else P.fit_profile(train, method)
    return evaluate(model.score(test))


Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def ml_classifier(make) -> Fit:
    """A pyspark.ml classifier over `_v` and the 0/1 column `_y`, as fit -> predict."""
    def fit(train: DataFrame):
        model = make().setFeaturesCol("_v").setLabelCol("_y").fit(train)
        return lambda test: model.transform(test).select("_y", "prediction")

    return fit


def default_classifiers() -> dict[str, Fit]:
    return {"logistic": ml_classifier(lambda: LogisticRegression(maxIter=20, tol=0.1)),
            "linear_svc": ml_classifier(lambda: LinearSVC(maxIter=20))}


def compare_classifiers(samples: DataFrame, models: Mapping[str, Fit] | None = None,
                        fractions: Sequence[float] = HELD_OUT, rounds: int = ROUNDS, seed: int = 42,
                        row_id: str = "row_id", vec: str = "features") -> DataFrame:
    """Mean held-out error of each classifier at each held-out fraction.

    Splits are a fixed hash of row and round, so nothing is shuffled to split. A trial is one fit; trials are
    few by nature, and each runs over the whole table.
    """
    spark = samples.sparkSession
    models = models or default_classifiers()
    data = samples.select(row_id, array_to_vector(F.col(vec)).alias("_v"),
                          F.when(F.col("label") == "P", 1.0).otherwise(0.0).alias("_y")).persist()
    errors = []
    try:
        for fraction in fractions:
            for r in range(rounds):
                held = hashed_share(F.col(row_id), F.lit(r), seed) < F.lit(float(fraction))
                for name, fit in models.items():
                    predict = fit(data.where(~held))
                    wrong = predict(data.where(held)).agg(
                        F.avg(F.when(F.col("_y") != F.col("prediction"), 1.0).otherwise(0.0))).first()[0]
                    errors.append((name, float(fraction), r, wrong))
    finally:
        data.unpersist()
    table = spark.createDataFrame(errors, "classifier string, fraction double, round int, error double")
    return table.groupBy("classifier", "fraction").agg(F.avg("error").alias("error"))


def feature_windows(dim: int, width: int = 10, overlap: int = 5) -> list[tuple[str, int, int]]:
    """ALL and the windows of `width` features that start every width - overlap."""
    step = width - overlap
    starts = range(0, dim - step, step)
    return [("ALL", 0, dim), *[(f"({s}, {s + width})", s, min(width, dim - s)) for s in starts]]


# ---- all trials at once -----------------------------------------------------------------------------

LOSSES = ("logistic", "linear_svc")


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of one packed array per task, added up in two levels."""
    few = max(1, int(parts.rdd.getNumPartitions() ** 0.5))

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    rows = parts.repartition(few).mapInArrow(add, "x binary").collect()
    return sum((np.frombuffer(r["x"]) for r in rows), np.zeros(width))


def linear_trials(samples: DataFrame, windows: Sequence[tuple[str, int, int]], fractions: Sequence[float] = HELD_OUT,
                  rounds: int = ROUNDS, seed: int = 42, row_id: str = "row_id", vec: str = "features",
                  steps: int = 40, penalty: float = 1e-3) -> DataFrame:
    """Held-out rows and errors of a logistic and a squared-hinge linear classifier, one line per (classifier, subset,
    fraction, round).

    All trials are fitted together: a step of gradient descent with momentum is one pass over the samples that sums the
    gradients of every trial, so that the passes do not grow with the number of trials. A trial's training rows are those whose
    hashed share is not below the fraction. Only weights (features times trials) reach the driver.
    """
    spark, dim = samples.sparkSession, common_width(samples, vec)
    data = filter_dimension(samples, dim, vec)
    stats = sorted(column_stats(data, vec).collect(), key=lambda r: r.pos)
    mean, std = np.array([r["mean"] for r in stats]), np.array([r["std"] or 1.0 for r in stats])
    shares = F.array(*[hashed_share(F.col(row_id), F.lit(r), seed) for r in range(rounds)])
    data = data.select(F.col(vec).alias("x"), (F.col("label") == "P").cast("int").alias("y"), shares.alias("s"))
    trials = [(f, r) for f in fractions for r in range(rounds)]
    cuts, at = np.array([f for f, _ in trials]), np.array([r for _, r in trials])
    allowed = np.zeros((dim + 1, len(windows)))  # the features of each subset, and the constant
    allowed[dim] = 1
    for i, (_, start, n) in enumerate(windows):
        allowed[start:start + n, i] = 1
    mask = np.repeat(allowed, len(trials), axis=1)
    shape = (len(LOSSES), dim + 1, mask.shape[1])

    def blocks(batches):
        for batch in batches:
            x = np.stack([np.array(v.as_py(), float) for v in batch.column(0)])
            x = np.hstack(((x - mean) / std, np.ones((len(x), 1))))
            held = np.array(batch.column(2).to_pylist())[:, at] < cuts
            yield x, batch.column(1).to_numpy().astype(float)[:, None], np.tile(held, len(windows))

    def passed(weights):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches):
            w, total, rows = shared.value, np.zeros(shape), np.zeros(shape[2])
            for x, y, held in blocks(batches):
                sign, train = 2 * y - 1, ~held
                rows += train.sum(0)
                total[0] += x.T @ ((1 / (1 + np.exp(-np.clip(x @ w[0], -30, 30))) - y) * train)
                total[1] -= 2 * x.T @ (sign * np.maximum(0, 1 - sign * (x @ w[1])) * train)
            packed = np.concatenate((total.ravel(), rows))
            yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["x"])

        size = int(np.prod(shape))
        found = _summed(data.mapInArrow(gradient, "x binary"), size + shape[2])
        return found[:size].reshape(shape), found[size:]

    w, last = np.zeros(shape), np.zeros(shape)
    rate = 1 / (np.array([0.25, 2.0])[:, None, None] * mask.sum(0))  # by the largest curvature of standardised features
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - last)
        gradients, rows = passed(ahead)
        last, w = w, (ahead - rate * (gradients / np.maximum(rows, 1) + penalty * ahead)) * mask
    final = spark.sparkContext.broadcast(w)

    def errors(batches):
        total = np.zeros((len(LOSSES) + 1, shape[2]))
        for x, y, held in blocks(batches):
            for i in range(len(LOSSES)):
                total[i] += ((((x @ final.value[i]) > 0) != (y > 0)) & held).sum(0)
            total[-1] += held.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    total = _summed(data.mapInArrow(errors, "x binary"), (len(LOSSES) + 1) * shape[2]).reshape(-1, shape[2])
    table = [(loss, name, float(f), r, int(total[-1, k]), int(total[i, k])) for i, loss in enumerate(LOSSES)
             for k, (name, (f, r)) in enumerate((n, t) for n, _, _ in windows for t in trials)]
    return spark.createDataFrame(table, "classifier string, subset string, fraction double, round int, held_out long, errors long")


def compare_feature_subsets(samples: DataFrame, width: int = 10, overlap: int = 5,
                            models: Mapping[str, Fit] | None = None, fractions: Sequence[float] = HELD_OUT,
                            rounds: int = ROUNDS, seed: int = 42, row_id: str = "row_id",
                            vec: str = "features") -> DataFrame:
    """Held-out error, in percent, of a classifier trained on each window of features."""
    models = models or {"linear_svc": default_classifiers()["linear_svc"]}
    dim = common_width(samples, vec)
    samples = filter_dimension(samples, dim, vec)
    out = None
    for name, start, n in feature_windows(dim, width, overlap):
        part = samples.withColumn(vec, F.slice(vec, start + 1, n))
        errors = compare_classifiers(part, models, fractions, rounds, seed, row_id, vec).select(
            F.lit(name).alias("subset"), "classifier", "fraction", (100 * F.col("error")).alias("error"))
        out = errors if out is None else out.unionByName(errors)
    return out
