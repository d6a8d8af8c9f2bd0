"""Searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import nearest_neighbours, top_k_search


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(3) for c in ("id", "v", "part", "pivot", "ring", "own", "block", "score", "rank", "d")})


def brute(ids, x, is_query, k):
    out = []
    for i in [i for i in ids if is_query(i)]:
        score = x @ x[list(ids).index(i)]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out += [(i, r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_exact_search_of_the_given_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float))
    found = top_k_search.search(df, lambda i: i % 50 == 0, 5, lambda v: np.floor(256 * v)).collect()
    assert sorted(map(tuple, found)) == brute(np.array([r.vec_id for r in rows]), x, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("block_rows,rings,pivots", [(16, 3, 4), (2048, 1, 1), (5, 8, 32)])
def test_exact_search_with_ties_norms_and_small_blocks(spark, block_rows, rings, pivots):
    r = np.random.default_rng(block_rows)
    x = np.vstack([np.tile([1.0, 2, 0, -1], (40, 1)), r.integers(-3, 4, (150, 4)), 9 * r.normal(size=(60, 4)), np.zeros((3, 4))])
    x = np.floor(4 * x)
    ids = np.arange(len(x)) * 3 - 30
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    odd = [(None, [1.0, 2.0, 3.0, 4.0]), (7000, None), (7001, [1.0, None, 2.0, 3.0]), (7002, [1.0, float("nan"), 0.0, 1.0]),
           (7003, [float("inf"), 0.0, 0.0, 1.0]), (7004, [1.0]), (7005, [])]
    found = top_k_search.search(table(spark, rows + odd), lambda i: i % 5 == 0, 4, pivots=pivots, rings=rings, block_rows=block_rows,
                                query_rows=7).collect()
    assert sorted(map(tuple, found)) == brute(ids, x, lambda i: i % 5 == 0, 4)


def test_few_or_no_rows(spark):
    for search in (top_k_search.search, nearest_neighbours.search):
        assert search(table(spark, []), lambda i: i % 5 == 0, 3).collect() == []
        assert search(table(spark, [(5, [1.0, 2.0])]), lambda i: i % 5 == 0, 3).collect() == []
        two = search(table(spark, [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [0.5, 1.0]), (10, [2.0, 0.0])]), lambda i: i % 5 == 0, 3)
        assert sorted(map(tuple, two.collect())) == [(5, 1, 6, 2.5), (5, 2, 10, 2.0), (10, 1, 5, 2.0), (10, 2, 6, 1.0)]


def test_recall_of_the_permutation_index(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    for args in ({}, {"rerank": len(rows) // 4, "block_rows": 1 << 20}):
        found = nearest_neighbours.search(df, lambda i: i % 20 == 0, 20, **args).collect()
        want = {(q, j): s for q, _, j, s in brute(ids, x, lambda i: i % 20 == 0, 20)}
        hits = [r for r in found if (r.query_id, r.vec_id) in want]
        assert all(r.score == pytest.approx(want[r.query_id, r.vec_id], abs=1e-12) for r in hits)
        assert len(found) == len(want) and len(hits) >= (0.9 if not args else 0.6) * len(want)


def test_zero_vectors_and_one_common_vector(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(1000, [0.0, 0.0]), (1001, None), (1002, [0.9, 0.1])]
    found = nearest_neighbours.search(table(spark, rows), lambda i: i % 20 == 0, 4, block_rows=50).collect()
    assert {r.query_id for r in found} == set(range(0, 300, 20))
    for q in range(0, 300, 20):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == [
            i for i in range(6) if i != q][:4]
