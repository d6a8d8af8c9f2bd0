"""Vectors as packed rows, bounded pivot samples and the merging of best candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import saved


def packed_vectors(df: DataFrame, transform, drop_zero: bool, id_col: str, vec_col: str) -> DataFrame:
    """(id, v binary of float64 values, norm2) of the rows that take part, as a saved table.

    `transform` maps a matrix of finite numbers to the matrix that is searched. Rows with a null id, a null vector or one
    that holds null or non-finite components are left out, as are rows of another width than the commonest one (of those the
    widest) and, if asked for, zero vectors.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    n = sizes[0]["n"] if sizes else 1

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            values = col.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
            x = values.reshape(-1, n)
            keep = np.isfinite(x).all(1)
            if drop_zero:
                keep &= (x != 0).any(1)
            x = np.ascontiguousarray(transform(x[keep]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(np.einsum("ij,ij->i", x, x))], names=["id", "v", "norm2"])

    return saved(rows.filter(F.size("v") == n).mapInArrow(run, "id long, v binary, norm2 double"), "vectors")


def matrix(column) -> np.ndarray:
    """The packed vectors of an Arrow column or a list of bytes."""
    rows = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def pivot_sample(vectors: DataFrame, n: int) -> np.ndarray:
    """`n` different vectors, or all if fewer, with the smallest hashes of their ids: what the driver holds is bounded."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(29)), "id", "v").limit(4 * n).collect()
    seen = list(dict.fromkeys(bytes(r["v"]) for r in rows))[:n]
    return matrix(seen)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Euclidean distances in the space where one more coordinate gives all rows the same norm.

    There, a query whose own coordinate is 0 is nearest to the row of largest inner product."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T + (lift[:, None] - pivot_lift) ** 2
    return np.sqrt(np.maximum(square, 0))


def lift_of(norm2: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - norm2, 0))


def best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best rows of each query: highest score, then smaller id."""
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    new = np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1]))) if len(queries) else np.zeros(0, int)
    rank = np.arange(len(queries)) - np.repeat(new, np.diff(np.append(new, len(queries))))
    keep = rank < k
    return queries[keep], ids[keep], scores[keep]


class Best:
    """Candidates of many queries, cut to the k best of each whenever they pile up."""

    def __init__(self, k: int, limit: int = 1 << 19):
        self.k, self.limit, self.parts, self.n = k, limit, [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((queries, ids, scores))
        self.n += len(queries)

    def full(self) -> bool:
        """True if even the best ones are too many to be kept: they can be handed out."""
        if self.n > self.limit:
            self.parts = [self.cut()]
            self.n = len(self.parts[0][0])
        return self.n > self.limit // 2

    def cut(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return best(*(np.concatenate([p[i] for p in self.parts]) for i in range(3)), self.k)

    def batch(self) -> pa.RecordBatch:
        q, i, s = self.cut()
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def ranks(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query; rows of one id count once, with their best score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query_batches(queries: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Queries in packed batches of about `rows`, one row each: (`by`..., part, ids array, q array of binary)."""
    counts = queries.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    split = queries.join(counts, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts"))) if by else (
        queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // rows))))))
    return split.groupBy(*by, "part").agg(F.collect_list(F.struct("id", "v")).alias("_rows")).select(
        *by, "part", F.col("_rows.id").alias("ids"), F.col("_rows.v").alias("q"))
