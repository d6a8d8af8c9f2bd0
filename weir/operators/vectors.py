"""Statistics over sample vectors and the assignment of vectors to centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import vectors as V
from weir.operators import metric as metrics
from weir.plans.skew import small_side


def column_stats(samples: DataFrame, vec: str = "features") -> DataFrame:
    """Mean, absolute value of the maximum and population deviation of each position."""
    return (
        samples.select(F.posexplode(vec).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.avg("v").alias("mean"), F.abs(F.max("v")).alias("max_abs"), F.stddev_pop("v").alias("std"))
    )


def _as_array(stats: DataFrame, column: str):
    """One row per position turned into one array, read as a scalar subquery."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", F.col(column).alias("v"))))
    return stats.agg(F.transform(pairs, lambda p: p["v"])).scalar()


def whiten(samples: DataFrame, vec: str = "features") -> DataFrame:
    """Divide each position by its population deviation; a constant position becomes null."""
    std = _as_array(column_stats(samples, vec), "std")
    return samples.withColumn("_std", std).withColumn(
        vec, F.zip_with(vec, "_std", lambda x, s: F.try_divide(x, s))).drop("_std")


def infer_radius(samples: DataFrame, k: int, vec: str = "features") -> DataFrame:
    """Root of the summed squared distance to the mean, over k squared. One row."""
    mean = _as_array(column_stats(samples, vec), "mean")
    spread = samples.withColumn("_mean", mean).select(V.squared_l2(F.col(vec), F.col("_mean")).alias("d"))
    return spread.agg((F.sqrt(F.sum("d")) / float(k * k)).alias("radius"))


def map_points(df: DataFrame, stats: DataFrame | None = None, polar: bool = False, vec: str = "features",
               name: str = "points") -> DataFrame:
    """Vectors as points of a circle map, flattened to x and y in turn. With `stats` of the flattened training
    points, points are stretched by their position's maximum."""
    df = df.withColumn(name, V.flatten_points(V.polar_points(F.col(vec), polar)))
    if stats is None:
        return df
    return df.withColumn("_max", _as_array(stats, "max_abs")).withColumn(
        name, V.stretch_by_max(F.col(name), F.col("_max"))).drop("_max")


def map_norms(df: DataFrame, stats: DataFrame, name: str = "points") -> DataFrame:
    """Two-number summary of mapped points against the training means."""
    return df.withColumn("_mean", _as_array(stats, "mean")).withColumn(
        "norm", V.map_norm(F.col(name), F.col("_mean"))).drop("_mean")


# ---- nearest centroid ------------------------------------------------------------------------------

def nearest_centroid(df: DataFrame, centroids: DataFrame, vec: str = "features", metric: str = "l2",
                     max_values: int = metrics.MAX_VALUES) -> DataFrame:
    """Add `cid` and `dist` (`l2` or `l1`) of the nearest row of `centroids` (cid, vec); the first of equal centroids wins.

    A codebook of up to `max_values` numbers travels with the tasks and the vectors never move. A larger one is partitioned
    by pivot and ring, and a vector is compared with the parts that can hold its nearest centroid.
    """
    book = centroids.select("cid", "vec").where("vec IS NOT NULL")
    size = book.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size.n:
        raise ValueError("the codebook is empty")
    if size.n * size.d > max_values:
        numbered = metrics.written(df.withColumn("_row", F.monotonically_increasing_id()), "vectors")
        found = metrics.nearest(numbered.select(F.col("_row").alias("row"), F.col(vec).cast("array<double>").alias("vec")),
                                book.select(F.col("cid").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), metric,
                                max_values=max_values)
        found = found.select(F.col("row").alias("_row"), F.col("id").alias("cid"), "dist")
        return numbered.join(found, "_row", "left").select(*df.columns, "cid", "dist")
    rows = book.orderBy("cid").collect()
    shared = df.sparkSession.sparkContext.broadcast(
        (np.array([r.cid for r in rows], dtype=np.int64), np.array([r.vec for r in rows], dtype=float)))

    @F.pandas_udf("cid long, dist double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, values = shared.value
        for batch in batches:
            yield _nearest(batch, ids, values, metric)

    return df.withColumn("_n", nearest(vec)).select(*df.columns, "_n.cid", "_n.dist")


def _nearest(block: pd.Series, ids: np.ndarray, book: np.ndarray, metric: str) -> pd.DataFrame:
    """Lowest distance per vector; the first of equal centroids wins."""
    cid = np.full(len(block), -1, dtype=np.int64)
    best = np.full(len(block), np.nan)
    present = block.notna().to_numpy()
    if present.any():
        rows = block[present].to_numpy()
        if any(len(r) != book.shape[1] for r in rows):
            raise ValueError(f"vectors must have {book.shape[1]} values like the codebook")
        x = np.stack(rows).astype(float)
        low, at = np.full(len(x), np.inf), np.full(len(x), -1, dtype=np.int64)
        for j in range(len(book)):
            d = metrics.METRICS[metric](x - book[j])
            closer = d < low
            low[closer], at[closer] = d[closer], ids[j]
        cid[present], best[present] = at, low
    return pd.DataFrame({"cid": pd.Series(cid).where(cid >= 0).astype("Int64"), "dist": pd.Series(best).where(present)})


def common_width(samples: DataFrame, vec: str = "features") -> int:
    """The width most vectors have; of equally many, the larger."""
    widths = samples.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    found = widths.orderBy(F.desc("rows"), F.desc("n")).first()
    if found is None:
        raise ValueError("no vectors")
    return found.n


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """Radius and size of each cluster."""
    return assigned.groupBy("cid").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("size"))


def distortion(assigned: DataFrame) -> DataFrame:
    return assigned.agg((F.sqrt(F.sum("dist")) / 2).alias("distortion"))


# ---- sample tables ---------------------------------------------------------------------------------

def filter_width(samples: DataFrame, vec: str = "features") -> DataFrame:
    """Keep the rows as wide as the widest row of their source."""
    widest = samples.groupBy("source").agg(F.max(F.size(vec)).alias("_width"))
    return (samples.join(small_side(widest), "source")
            .where(F.size(vec) == F.col("_width")).select(*samples.columns))


def filter_dimension(df: DataFrame, dim: int, vec: str = "features") -> DataFrame:
    return df.where(F.size(vec) == dim)


def union_samples(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def systematic_sample(df: DataFrame, *order: str, step: int = 10) -> DataFrame:
    """Every step-th row from the first, in the order of the given columns."""
    from weir.plans.ordering import with_position

    return with_position(df, *order, name="_pos").where(F.col("_pos") % step == 0).drop("_pos")


def sample_per_class(df: DataFrame, n: int = 15, seed: int = 42, row_id: str = "row_id", share=None) -> DataFrame:
    """n rows of each label, those of the smallest share: a seeded hash of the row id, or `share(row_id, seed)`."""
    order = share(F.col(row_id), seed) if share else F.xxhash64(row_id, F.lit(seed))
    w = Window.partitionBy("label").orderBy(order, row_id)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


# Held-out shares and repeats of the classifier comparison (fixed values).
HELD_OUT = (0.95, 0.90, 0.75, 0.50, 0.01)
ROUNDS = 20


def hashed_share(row_id, trial, seed: int):
    """A number in [0, 1) fixed by row, trial and seed."""
    return F.pmod(F.xxhash64(row_id, trial, F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def holdout_splits(df: DataFrame, fractions=HELD_OUT, rounds: int = ROUNDS, seed: int = 42,
                   row_id: str = "row_id", share=hashed_share) -> DataFrame:
    """Each row once per round and fraction, with `held_out` set for about that fraction of the rows."""
    trials = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    cuts = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    return (df.select("*", trials).select("*", cuts)
            .withColumn("held_out", share(F.col(row_id), F.col("round"), seed) < F.col("fraction")))
