"""Profiles of normal traffic: clustering, one-class scores, projections and their use on new rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import vectors as V
from weir.operators import vectors as N
from weir.operators.metric import leader_cluster, vectors_of, written
from weir.operators.trees import cut_tree, merge_tree
from weir.plans.ordering import with_position
from weir.session import bounded_batches, ensure_checkpoint_dir

# Centroids of a fitted profile, and those added at most each time it grows.
PROFILE_SIZE = 64
GROWTH = 16
# Vectors of a block where all rows meet all.
BLOCK = 1024


# ---- clustering ------------------------------------------------------------------------------------

def kmeans(samples: DataFrame, k: int, tol: float = 1e-5, iters: int = 20, seed: int = 42,
           vec: str = "features") -> DataFrame:
    """Lloyd's k-means: at most k centroids (cid, vec), no more than there are different vectors."""
    spark = samples.sparkSession
    k = min(k, samples.select(vec).distinct().limit(k).count())
    if k == 1:  # the library asks for two
        return samples.select(F.lit(0).cast("long").alias("cid"), F.col(vec).cast("array<double>").alias("vec")).limit(1)
    model = KMeans(k=k, maxIter=iters, tol=tol, seed=seed, featuresCol="_v").fit(
        samples.select(array_to_vector(F.col(vec)).alias("_v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cid long, vec array<double>")


def merged_centres(centres: np.ndarray, cut: float) -> np.ndarray:
    """Merge the closest two of a profile's centres into their midpoint while they are closer than `cut`."""
    centres = [c for c in np.asarray(centres, dtype=float)]
    while len(centres) > 1:
        x = np.stack(centres)
        gap = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
        gap[np.tril_indices(len(x))] = np.inf
        i, j = divmod(int(gap.argmin()), len(x))
        if gap[i, j] >= cut:
            break
        centres[i] = (centres[i] + centres[j]) / 2.0
        del centres[j]
    return np.stack(centres)


# ---- profiles --------------------------------------------------------------------------------------

class Scorer(Protocol):
    """A fitted model of normal rows: adds `score` and `predicted` to a table of vectors."""

    def score(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Profile:
    """Centroids (cid, vec, size, label) and the radius inside which a row counts as normal."""

    centroids: DataFrame
    max_radius: float
    min_dist: float
    init_size: int
    vec: str = "features"

    def score(self, df: DataFrame) -> DataFrame:
        return classify(df, self)


def _labelled(centroids: DataFrame) -> DataFrame:
    return centroids.select("cid", "vec", F.lit(0.001).alias("size"), F.concat(F.lit("group "), F.col("cid").cast("string")).alias("label"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """(cid, vec) of rows, numbered in their order."""
    return _labelled(with_position(rows, *order, name="cid").select("cid", F.col("vec").cast("array<double>").alias("vec"))).checkpoint()


def leader_centroids(samples: DataFrame, radius: float, order_by: str, id_col: str, vec: str = "features") -> DataFrame:
    """The leaders among the rows as centroids, numbered in the order of `order_by` and id. Ids are unique."""
    led = leader_cluster(samples, radius, order_by, id_col, vec).where(F.col("leader") == F.col(id_col)).select(id_col)
    return _numbered(samples.join(led, id_col).select(F.col(order_by).alias("_at"), F.col(id_col).alias("_id"), F.col(vec).alias("vec")), "_at", "_id")


def kmeans_by_radius(samples: DataFrame, k: int, order_by: str = "row_id", id_col: str = "row_id", vec: str = "features") -> DataFrame:
    """Centroids by the radius inferred for k: the leaders, none within it of an earlier one, however many they are."""
    return leader_centroids(samples, float(N.infer_radius(samples, k, vec).first()["radius"]), order_by, id_col, vec)


def tree_centroids(samples: DataFrame, threshold: float, id_col: str = "row_id", vec: str = "features") -> DataFrame:
    """The clusters of a merge tree cut at `threshold` as centroids, where their nodes stand, numbered by least leaf."""
    tree = merge_tree(samples, id_col, vec)
    nodes = tree.leaves.select("node", F.col("node").alias("first"), "vec").unionByName(tree.merges.select("node", "first", "vec"))
    return _numbered(nodes.join(cut_tree(tree, threshold).select("node").distinct(), "node"), "first")


def fit_profile(samples: DataFrame, method: str = "hier", size: int = PROFILE_SIZE, threshold: float | None = None,
                vec: str = "features", seed: int = 42, order_by: str = "row_id", id_col: str = "row_id") -> Profile:
    """A profile of normal rows, fitted to all rows at every size of the table.

    By k-means with at most `size` centroids: `hier` merges centroids closer than the threshold (a tenth of the rows if not
    given), which is also the radius; `flat` keeps the centroids, with the threshold (or the radius inferred for `size`) as
    the least distance, and a radius of twice the largest distance seen. By the rows themselves: `leader` takes the leaders
    in the order of `order_by`, none within the threshold of an earlier one, and `tree` the clusters of a merge tree cut at
    the threshold; the threshold (the inferred radius if not given) is also the radius.
    """
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    if method in ("leader", "tree"):
        radius = float(N.infer_radius(samples, size, vec).first()["radius"] if threshold is None else threshold)
        centroids = leader_centroids(samples, radius, order_by, id_col, vec) if method == "leader" else tree_centroids(samples, radius, id_col, vec)
        return Profile(centroids, radius, radius if method == "leader" else radius / 3, centroids.count(), vec)
    book = np.array([r.vec for r in kmeans(samples, size, seed=seed, vec=vec).orderBy("cid").collect()])
    if method == "hier":
        radius = float(samples.count() // 10 if threshold is None else threshold)
        book, min_dist = merged_centres(book, radius), radius / 3
    elif method == "flat":
        min_dist = float(N.infer_radius(samples, size, vec).first()["radius"] if threshold is None else threshold)
    else:
        raise ValueError("method must be 'hier', 'flat', 'leader' or 'tree'")
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(book)]
    centroids = _labelled(spark.createDataFrame(rows, "cid long, vec array<double>"))
    if method == "flat":
        radius = 2 * N.nearest_centroid(samples, centroids, vec).agg(F.max("dist").alias("d")).first()["d"]
    return Profile(centroids, radius, min_dist, len(rows), vec)


def conform(dist: Column, radius: float) -> Column:
    return F.when(dist < radius, "P").otherwise("N")


def classify(df: DataFrame, profile: Profile) -> DataFrame:
    """Add cid, dist, predicted (P inside the radius, else N) and score (1 or 0)."""
    near = N.nearest_centroid(df, profile.centroids, profile.vec)
    return near.withColumn("predicted", conform(F.col("dist"), profile.max_radius)).withColumn(
        "score", F.when(F.col("predicted") == "P", 1).otherwise(0))


def grow_profile(profile: Profile, batch: DataFrame, growth: int = GROWTH, seed: int = 42,
                 leaders: tuple[str, str] | None = None) -> tuple[Profile, DataFrame]:
    """Cluster the rows at or beyond the radius into at most `growth` new centroids and assign those rows to them.

    With `leaders` (the columns of order and id) the new centroids are the leaders among those rows, none within the radius
    of an earlier one, and however many there are. Sizes become the largest distance assigned so far; labels stay.
    """
    vec, spark = profile.vec, batch.sparkSession
    ensure_checkpoint_dir(spark)
    near = N.nearest_centroid(batch, profile.centroids, vec).checkpoint()
    far = near.where(F.col("dist") >= profile.max_radius).select(*batch.columns)
    centroids = profile.centroids
    if far.take(1):
        offset = centroids.agg(F.max("cid")).first()[0] + 1
        new = leader_centroids(far, profile.max_radius, *leaders, vec) if leaders else kmeans(far, growth, seed=seed, vec=vec)
        new = _labelled(new.select((F.col("cid") + offset).alias("cid"), "vec"))
        near = near.where(F.col("dist") < profile.max_radius).unionByName(N.nearest_centroid(far, new, vec)).checkpoint()
        centroids = centroids.unionByName(new)
    reach = N.cluster_summary(near).select("cid", "radius")
    centroids = centroids.join(reach, "cid", "left").select(
        "cid", "vec", F.greatest("size", "radius").alias("size"), "label").checkpoint()
    return replace(profile, centroids=centroids), near


# ---- one-class score -------------------------------------------------------------------------------

@dataclass(frozen=True)
class OneClass:
    """Mean kernel to weighted centres, or to every row of the table `book`, cut at a quantile of the training rows."""

    centres: tuple
    weights: tuple
    gamma: float
    cutoff: float
    labels: dict
    vec: str = "features"
    book: DataFrame | None = None

    def score(self, df: DataFrame) -> DataFrame:
        return score_one_class(df, self)


def _kernel_mean(df: DataFrame, centres, weights, gamma: float, vec: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((np.array(centres), np.array(weights)))

    @F.pandas_udf("double")
    def mean_kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c, w = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, c.shape[1]))
            total = np.zeros(len(x))
            for j in range(len(c)):
                total += w[j] * np.exp(-gamma * ((x - c[j]) ** 2).sum(axis=1))
            yield pd.Series(total / w.sum())

    return df.withColumn("kernel_mean", mean_kernel(vec))


def _vector_blocks(df: DataFrame, vec: str) -> DataFrame:
    """Vectors as blocks (n, rows, matrix) of up to BLOCK rows; `rows` are their numbers in `_row`."""
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for a in range(0, len(column), BLOCK):
                part = column.slice(a, BLOCK)
                matrix, _ = vectors_of(part, len(part[0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)]), pa.array([batch.column(0).slice(a, BLOCK).to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([matrix.tobytes()], pa.binary())], names=["n", "rows", "matrix"])

    some = df.where(F.col(vec).isNotNull()).select("_row", F.col(vec).cast("array<double>").alias("v"))
    return written(some.mapInArrow(run, "n long, rows binary, matrix binary"), "vector-blocks")


def _kernel_mean_all(df: DataFrame, book: DataFrame, gamma: float, vec: str) -> DataFrame:
    """The mean kernel to all rows of the blocks `book`: blocks meet blocks, so no task holds more than one of either side."""
    bounded_batches(df.sparkSession)
    count = book.agg(F.sum("n")).first()[0]
    numbered = written(df.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    pairs = _vector_blocks(numbered, vec).select("rows", "matrix").crossJoin(book.select("n", F.col("matrix").alias("centres")))

    def run(batches):
        for batch in batches:
            for rows, matrix, n, centres in zip(*(batch.column(i) for i in range(4))):
                own = np.frombuffer(rows.as_buffer(), "<i8")
                c = np.frombuffer(centres.as_buffer(), "<f8").reshape(n.as_py(), -1)
                x = np.frombuffer(matrix.as_buffer(), "<f8").reshape(len(own), -1)
                if x.shape[1] != c.shape[1]:
                    raise ValueError(f"vectors must have {c.shape[1]} values")
                squares = (x ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * (x @ c.T)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.exp(-gamma * np.maximum(squares, 0)).sum(1))], names=["_row", "k"])

    sums = pairs.mapInArrow(run, "_row long, k double").groupBy("_row").agg((F.sum("k") / count).alias("kernel_mean"))
    return numbered.join(sums, "_row", "left").drop("_row")


def learn_label_map(scored: DataFrame) -> DataFrame:
    """Score to label, from each label's commonest score (the larger of equals)."""
    counts = scored.groupBy("label", "score").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.groupBy("label").agg(F.max(F.struct("_n", "score")).alias("_c"))
    return common.groupBy(F.col("_c.score").alias("score")).agg(F.max_by("label", F.struct("_c._n", "label")).alias("label"))


def fit_one_class(samples: DataFrame, nu: float = 0.01, gamma: float = 1e-5, max_centres: int | None = 1024,
                  vec: str = "features", seed: int = 42) -> OneClass:
    """The kernel centres are at most `max_centres` training rows, those of the smallest seeded hash of their vector, at every
    size of the table; None takes all of them, which a table of blocks holds. The cutoff is the nu quantile of all training rows'
    scores, exact and with 1e-12 for the order of sums where all are centres. That work grows with rows times training rows."""
    if max_centres is None:
        book = _vector_blocks(samples.withColumn("_row", F.monotonically_increasing_id()), vec)
        own = written(_kernel_mean_all(samples, book, gamma, vec), "kernel-means")
        n = own.where("kernel_mean IS NOT NULL").count()
        if not n:
            raise ValueError("no training rows")
        least = own.where("kernel_mean IS NOT NULL").select("kernel_mean").orderBy("kernel_mean")
        centres, weights, cutoff = (), (), least.offset(max(1, math.ceil(n * nu)) - 1).limit(1).first()[0] - 1e-12
    else:
        rows = samples.select(F.col(vec).alias("v")).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(max_centres).collect()
        centres, weights, book = tuple(tuple(r.v) for r in rows), tuple(1.0 for _ in rows), None
        own = _kernel_mean(samples, centres, weights, gamma, vec)
        cutoff = own.agg(F.percentile_approx("kernel_mean", nu, 100_000)).first()[0]
    scored = own.withColumn("score", F.when(F.col("kernel_mean") >= cutoff, 1).otherwise(-1))
    labels = {r.score: r.label for r in learn_label_map(scored).collect()} if "label" in samples.columns else {1: "P"}
    return OneClass(centres, weights, gamma, float(cutoff), labels, vec, book)


def score_one_class(df: DataFrame, model: OneClass) -> DataFrame:
    """Add score (+1 inside, -1 outside) and predicted (UNKNOWN for a score no label maps to)."""
    if model.book is None:
        out = _kernel_mean(df, model.centres, model.weights, model.gamma, model.vec)
    else:
        out = _kernel_mean_all(df, model.book, model.gamma, model.vec)
    out = out.withColumn("score", F.when(F.col("kernel_mean") >= model.cutoff, 1).otherwise(-1))
    label = F.lit("UNKNOWN")
    for score, name in sorted(model.labels.items()):
        label = F.when(F.col("score") == score, name).otherwise(label)
    return out.withColumn("predicted", label)


@dataclass(frozen=True)
class KernelMean:
    """Mean of the training rows' kernel features, cut at a quantile of their scores."""

    mean: tuple
    dim: int
    gamma: float
    seed: int
    cutoff: float
    vec: str = "features"

    def score(self, df: DataFrame) -> DataFrame:
        """Add kernel_mean, score (+1 inside, -1 outside) and predicted (P inside, else UNKNOWN)."""
        mean, weights, shifts = np.array(self.mean), *kernel_weights(len(self.mean), self.dim, self.gamma, self.seed)
        out = df.withColumn("kernel_mean", _kernel_score(mean, weights, shifts)(F.col(self.vec)))
        out = out.withColumn("score", F.when(F.col("kernel_mean") >= self.cutoff, 1).otherwise(-1))
        return out.withColumn("predicted", F.when(F.col("score") == 1, "P").otherwise("UNKNOWN"))


def kernel_weights(n: int, dim: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (n, dim) and shifts of random cosine features of the kernel exp(-gamma d^2), from md5 sums of their places."""
    def share(*place) -> float:
        return (int(md5("-".join(map(str, place)).encode()).hexdigest()[:12], 16) + 0.5) / 16 ** 12

    normal = [[math.sqrt(-2 * math.log(share("a", seed, i, j))) * math.cos(2 * math.pi * share("b", seed, i, j)) for j in range(dim)] for i in range(n)]
    return math.sqrt(2 * gamma) * np.array(normal).reshape(n, dim), np.array([2 * math.pi * share("c", seed, i) for i in range(n)])


def _kernel_features(x: np.ndarray, weights: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return math.sqrt(2 / len(shifts)) * np.cos(x @ weights.T + shifts)


def _kernel_score(mean: np.ndarray, weights: np.ndarray, shifts: np.ndarray):
    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        out, some = pd.Series(np.nan, index=batch.index), batch.notna()
        if some.any():
            out[some] = _kernel_features(np.stack(batch[some].to_numpy()).astype(float), weights, shifts) @ mean
        return out.astype(object).where(some, None)

    return score


def fit_kernel_mean(samples: DataFrame, nu: float = 0.01, gamma: float = 1e-5, size: int = 512, vec: str = "features", seed: int = 42) -> KernelMean:
    """A one-class score over all training rows: the mean kernel to every one of them, by `size` random cosine features.

    The mean of the features is summed by the tasks, so neither the score's cost nor what the driver holds grows with the rows;
    the error of a score falls with the root of `size`. The cutoff is the nu quantile of all training rows' scores.
    Null vectors and those of another than the commonest width are left out of the fit.
    """
    dim = N.common_width(samples, vec)
    rows = N.filter_dimension(samples, dim, vec)
    weights, shifts = kernel_weights(size, dim, gamma, seed)

    def sums(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            x, _ = vectors_of(batch.column(0), dim)
            total, n = total + _kernel_features(x, weights, shifts).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array([*total.tolist(), float(n)])], names=["pos", "v"])

    parts = rows.select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(sums, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    total = np.array([r["v"] for r in sorted(parts.collect())])
    model = KernelMean(tuple((total[:size] / total[size]).tolist()), dim, gamma, seed, -np.inf, vec)
    cutoff = model.score(rows).agg(F.percentile_approx("kernel_mean", nu, 100_000)).first()[0]
    return replace(model, cutoff=float(cutoff))


# ---- projection ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Projection:
    """Principal components (largest first), their singular values, and the mean of the data."""

    components: tuple
    singular_values: tuple
    mean: tuple


def fit_pca(samples: DataFrame, vec: str = "features") -> Projection:
    """Components of the vectors of the commonest width; others are left out."""
    dim = N.common_width(samples, vec)
    samples = N.filter_dimension(samples, dim, vec)
    model = PCA(k=dim, inputCol="_v", outputCol="_p").fit(samples.select(array_to_vector(F.col(vec)).alias("_v")))
    n = samples.count()
    stats = {r.pos: r for r in N.column_stats(samples, vec).collect()}  # one row per position
    scatter = n * sum(stats[i]["std"] ** 2 for i in range(dim))
    shares = model.explainedVariance.toArray()
    return Projection(tuple(map(tuple, model.pc.toArray().T)), tuple(np.sqrt(shares * scatter)),
                      tuple(stats[i]["mean"] for i in range(dim)))


def project(df: DataFrame, pca: Projection, vec: str = "features", name: str = "projected") -> DataFrame:
    """Components times the vector, which is not centred."""
    matrix = np.array(pca.components)

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(batch.to_numpy()).astype(float) @ matrix.T)) if len(batch) else batch

    return df.withColumn(name, apply(vec))


# ---- scores to verdicts ----------------------------------------------------------------------------

# Packet scores (fixed values).
SCORE_NORMAL, SCORE_OUTSTANDING, SCORE_FLAGGED = -3, 1, 3

Policy = Callable[[Column], Column]


def strict(score: Column) -> Column:
    return F.when(score >= SCORE_OUTSTANDING, "DROP").otherwise("ACCEPT")


def accept_all(score: Column) -> Column:
    return F.lit("ACCEPT")


POLICIES: dict[str, Policy] = {"STRICT": strict, "PERMISSIVE": accept_all, "LEARNING": accept_all}


def packet_score(profile_score: Column, rejected: Column) -> Column:
    return F.when(rejected, SCORE_FLAGGED).when(profile_score == 1, SCORE_NORMAL).otherwise(SCORE_OUTSTANDING)


def verdict(df: DataFrame, mode: str | Policy = "STRICT", score: str = "score", rejected: str | None = None) -> DataFrame:
    """Add packet_score and verdict; `mode` names a policy or is one."""
    policy = POLICIES[mode] if isinstance(mode, str) else mode
    bad = F.col(rejected) if rejected else F.lit(False)
    df = df.withColumn("packet_score", packet_score(F.col(score), bad))
    return df.withColumn("verdict", policy(F.col("packet_score")))
