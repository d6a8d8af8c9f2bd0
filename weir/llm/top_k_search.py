"""Exact top-k search by inner product over a pivot-distance index.

One more coordinate gives all vectors the same norm, so that the largest inner product is the smallest Euclidean distance.
Every vector is keyed by its nearest pivot and its distance to it; the distances of one pivot are cut into rings (annuli), the
rings into blocks that are sorted by distance. A first pass over one block of each ring of a query's own pivot gives a distance
that k rows certainly reach; by the triangle inequality only rings, and within a block only a run of the sorted rows, whose
distances to the pivot differ from the query's by no more than that can hold a better row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import saved
from weir.llm.vectors import FOUND, Best, distances, lift_of, matrix, packed_vectors, pivot_sample, query_batches, ranks


def search(df: DataFrame, is_query, k: int = 5, transform=lambda x: x, pivots: int = 32, rings: int = 8,
           block_rows: int = 2048, query_rows: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest inner product for every query, ties to the smaller id.

    `is_query` is a condition over the column `id`; candidates are all rows but those of the query's own id. `transform`
    maps the matrix before the search. Null ids, null or non-finite vectors and vectors of an uncommon width take no part;
    rows of one id count once; fewer than k candidates are all returned; an empty table gives no rows. The driver holds
    `pivots` vectors and `pivots` x `rings` bounds.
    """
    spark = df.sparkSession
    vectors = packed_vectors(df, transform, False, id_col, vec_col)
    most = vectors.agg(F.max("norm2")).collect()[0][0] or 0.0
    centres = pivot_sample(vectors, pivots)
    if not len(centres):
        return ranks(spark.createDataFrame([], FOUND), k)
    centre_lift = lift_of((centres * centres).sum(1), most)
    slack = 1e-6 * (1 + most)  # of squared distances, for rounding

    def nearest(batches):
        for batch in batches:
            x, norm2 = matrix(batch.column(1)), batch.column(2).to_numpy()
            out = []
            for lift in (lift_of(norm2, most), np.zeros(len(x))):
                d = distances(x, lift, centres, centre_lift)
                own = d.argmin(1)
                out += [pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out],
                                             names=["id", "v", "pivot", "d", "query_pivot", "query_d"])

    keyed = saved(vectors.mapInArrow(nearest, "id long, v binary, pivot int, d double, query_pivot int, query_d double"), "keyed")
    shares = [i / rings for i in range(1, rings)]
    cuts = {r["pivot"]: sorted(set(r["q"] or [])) for r in keyed.groupBy("pivot").agg(
        F.percentile_approx("d", shares, 1000).alias("q")).collect()}
    bounds = F.create_map(*[F.lit(x) for p, q in cuts.items() for x in (p, q)]) if rings > 1 and cuts else None
    ring = F.size(F.filter(bounds[F.col("pivot")], lambda b: b < F.col("d"))) if bounds is not None else F.lit(0)
    ringed = keyed.withColumn("ring", ring)
    directory = ringed.groupBy("pivot", "ring").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")).collect()
    parts = F.create_map(*[F.lit(x) for r in directory for x in (r["pivot"] * rings + r["ring"], r["parts"])])
    blocks = saved(
        ringed.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("pivot") * rings + F.col("ring")]).cast("int"))
        .groupBy("pivot", "ring", "part").agg(F.sort_array(F.collect_list(F.struct("d", "id", "v"))).alias("_rows"))
        .select("pivot", "ring", "part", F.col("_rows.d").alias("d"), F.col("_rows.id").alias("ids"),
                F.col("_rows.v").alias("x")), "blocks")
    queries = keyed.filter(is_query(F.col("id"))).select("id", "v", F.col("query_pivot").alias("own"))
    batches = saved(query_batches(queries, ["own"], query_rows), "queries")

    def scan(rows, with_reach: bool):
        found = Best(k)
        for batch in rows:
            cols = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                q, x = matrix(cols["q"][i].as_py()), matrix(cols["x"][i].as_py())
                qid, xid = np.array(cols["ids"][i].as_py()), np.array(cols["x_ids"][i].as_py())
                least = np.full(len(q), -np.inf)
                if with_reach:
                    least = np.array(cols["least"][i].as_py())
                    d, p = np.array(cols["d"][i].as_py()), cols["pivot"][i].as_py()
                    reach, to = _reach(q, least, most, slack), distances(q, np.zeros(len(q)), centres[[p]], centre_lift[[p]])[:, 0]
                    lo, hi = np.searchsorted(d, to - reach), np.searchsorted(d, to + reach, "right")
                    some = np.flatnonzero(lo < hi)
                    if not len(some):
                        continue
                    a, b = lo[some].min(), hi[some].max()
                    q, qid, least, x, xid = q[some], qid[some], least[some], x[a:b], xid[a:b]
                score = q @ x.T
                score[qid[:, None] == xid] = -np.inf
                kth = np.partition(score, -k, 1)[:, -k] if score.shape[1] > k else np.full(len(q), -np.inf)
                at, of = np.nonzero((score >= np.maximum(kth, least)[:, None]) & (score > -np.inf))
                found.add(qid[at], xid[of], score[at, of])
            if found.full():
                yield found.batch()
        yield found.batch()

    block = blocks.select("pivot", "ring", "part", "d", F.col("ids").alias("x_ids"), "x")
    batch = batches.select("own", F.col("part").alias("q_part"), "ids", "q")
    first = batch.join(block.filter(F.col("part") == 0), F.col("own") == F.col("pivot")).select("ids", "q", "x_ids", "x")
    sure = ranks(first.mapInArrow(lambda rows: scan(rows, False), FOUND), k).filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("least"))
    # every query with the score that k rows certainly reach
    aimed = queries.join(sure, "id", "left").select("own", "id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    sized = aimed.join(aimed.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("_n")), "own")
    batch = saved(sized.groupBy("own", F.pmod(F.xxhash64("id"), F.col("_n")).alias("q_part")).agg(
        F.collect_list(F.struct("id", "v", "least")).alias("_rows")).select(
        "own", "q_part", F.col("_rows.id").alias("ids"), F.col("_rows.v").alias("q"), F.col("_rows.least").alias("least")), "aimed")

    def rings_within(rows):
        for b in rows:
            own, q_part, pivot, ring, part = [], [], [], [], []
            for i in range(b.num_rows):
                q, least = matrix(b.column(2)[i].as_py()), np.array(b.column(3)[i].as_py())
                reach = _reach(q, least, most, slack)
                to = distances(q, np.zeros(len(q)), centres, centre_lift)
                for r in directory:
                    d = to[:, r["pivot"]]
                    if ((d - reach <= r["hi"]) & (d + reach >= r["lo"])).any():
                        for j in range(r["parts"]):
                            own.append(b.column(0)[i].as_py())
                            q_part.append(b.column(1)[i].as_py())
                            pivot.append(r["pivot"])
                            ring.append(r["ring"])
                            part.append(j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(q_part, pa.int64()), *(pa.array(c, pa.int32()) for c in (pivot, ring, part))],
                names=["own", "q_part", "pivot", "ring", "part"])

    asked = batch.select("own", "q_part", "q", "least").mapInArrow(
        rings_within, "own int, q_part long, pivot int, ring int, part int")
    pairs = asked.join(block, ["pivot", "ring", "part"]).join(batch, ["own", "q_part"]).select(
        "ids", "q", "least", "pivot", "d", "x_ids", "x")
    return ranks(pairs.mapInArrow(lambda rows: scan(rows, True), FOUND), k)


def _reach(q: np.ndarray, least: np.ndarray, most: float, slack: float) -> np.ndarray:
    """The distance within which every row scores at least `least`."""
    return np.sqrt(np.maximum((q * q).sum(1) + most - 2 * least, 0) + slack)
