"""Approximate nearest neighbours by inner product over a permutation index.

Every vector is known by its `prefix` nearest pivots in order. Vectors are dealt into blocks by a hash of their ids; a block
keeps one inverted file per pivot, with the rows that have it among their nearest and the place it has there. A query visits
the files of its own pivots and sums up the footrule distance (a pivot that is missing counts as place `prefix`); the `rerank`
rows of least distance of each block, ties included, are scored by the exact inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import saved
from weir.llm.vectors import FOUND, Best, distances, lift_of, matrix, packed_vectors, pivot_sample, query_batches, ranks


def inverted_files(order: np.ndarray, pivots: int):
    """(rows, places, offsets by pivot) of the pivot orders of a block."""
    n, prefix = order.shape
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    return by // prefix, (by % prefix).astype(np.int16), np.searchsorted(flat[by], np.arange(pivots + 1))


def footrule(order: np.ndarray, files, n: int, prefix: int) -> np.ndarray:
    """Footrule distances, up to a constant, of n rows to one query with the given pivot order."""
    rows, places, offsets = files
    total = np.zeros(n, np.int32)
    for i, p in enumerate(order.tolist()):
        a, b = offsets[p], offsets[p + 1]
        # had the row not had this pivot: prefix - i; in its own sum the pivot stands with prefix - place
        total[rows[a:b]] += np.abs(places[a:b] - i) - (prefix - i) - (prefix - places[a:b])
    return total


def search(df: DataFrame, is_query, k: int = 20, pivots: int = 128, prefix: int = 32, rerank: int = 1000,
           block_rows: int = 4096, query_rows: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every query, ties to the smaller id.

    `is_query` is a condition over the column `id`; candidates are all rows but those of the query's own id; the score is
    the inner product in double precision. The pivots are a bounded sample, all rows are indexed. Null ids, zero, null or
    non-finite vectors and vectors of an uncommon width take no part; rows of one id count once; at most k candidates are
    all returned; an empty table gives no rows.
    """
    vectors = packed_vectors(df, lambda x: x, True, id_col, vec_col)
    summary = vectors.agg(F.max("norm2"), F.count(F.lit(1))).collect()[0]
    most, n = summary[0] or 0.0, summary[1]
    centres = pivot_sample(vectors, pivots)
    if not n:
        return ranks(df.sparkSession.createDataFrame([], FOUND), k)
    centre_lift = lift_of((centres * centres).sum(1), most)
    depth = min(prefix, len(centres))

    def orders(x, lift):
        d = distances(x, lift, centres, centre_lift)
        near = np.argpartition(d, depth - 1, 1)[:, :depth] if depth < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1).astype(np.int16)

    def index(batches):
        for batch in batches:
            order = orders(matrix(batch.column(1)), lift_of(batch.column(2).to_numpy(), most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in order], pa.binary())],
                                             names=["id", "v", "pivots"])

    parts = max(1, -(-n // block_rows))
    blocks = (vectors.mapInArrow(index, "id long, v binary, pivots binary")
              .groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("block"))
              .agg(F.collect_list(F.struct("id", "v", "pivots")).alias("_rows"))
              .select("block", F.col("_rows.id").alias("x_ids"), F.col("_rows.v").alias("x"), F.col("_rows.pivots").alias("pivots")))
    batches = saved(query_batches(vectors.filter(is_query(F.col("id"))).select("id", "v"), [], query_rows), "queries")
    asked = batches.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"))
    pairs = asked.join(saved(blocks, "index"), "block").join(batches, "part").select("ids", "q", "x_ids", "x", "pivots")

    def scan(rows):
        found = Best(k)
        for batch in rows:
            cols = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                q, x = matrix(cols["q"][i].as_py()), matrix(cols["x"][i].as_py())
                qid, xid = np.array(cols["ids"][i].as_py()), np.array(cols["x_ids"][i].as_py())
                order = np.frombuffer(b"".join(cols["pivots"][i].as_py()), np.int16).reshape(len(x), depth)
                files = inverted_files(order, len(centres))
                some = min(len(x), max(k + 1, rerank))
                for own, v, o in zip(qid, q, orders(q, np.zeros(len(q)))):
                    total = footrule(o, files, len(x), depth)
                    near = np.flatnonzero(total <= np.partition(total, some - 1)[some - 1])
                    near = near[xid[near] != own]
                    score = x[near] @ v
                    if len(near) > k:
                        keep = score >= np.partition(score, -k)[-k]
                        near, score = near[keep], score[keep]
                    found.add(np.full(len(near), own), xid[near], score)
            if found.full():
                yield found.batch()
        yield found.batch()

    return ranks(pairs.mapInArrow(scan, FOUND), k)
