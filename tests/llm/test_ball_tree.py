"""Ranked search against plain Python, and the bounds of the balls."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_samples import CLASHES, ODD, prose
from weir.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def queries(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(7) for c in CLASHES + ["query", "item", "score", "salt"]})


def test_ranks_of_odd_tables(spark, documents):
    docs = ODD + [(100 + i, prose(40 + i % 7, i % 30)) for i in range(90)] + [(500 + i, "the very same words again") for i in range(70)]
    items = [(1, prose(30, 3)), (2, None), (3, ""), (4, "same WORDS here"), (4, "same WORDS here"), (None, "id friend"), (5, "none of that"),
             (6, "\U0001f600 İ 12345 'start"), (7, "the very same words again"), (8, " ".join(prose(20, i) for i in range(30)))]
    want = ranked(docs, items, 50)
    for args in ({}, {"block_rows": 16, "leaf": 4, "query_bytes": 200}, {"leaf": 1}):
        got = ball_tree.search(documents(docs), queries(spark, items), **args).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert ball_tree.search(documents(docs), queries(spark, [])).collect() == []
    assert ball_tree.search(documents([]), queries(spark, items)).collect() == []
    assert ball_tree.search(documents([(1, None), (2, " .")]), queries(spark, items)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(1, 30), st.integers(1, 9), st.integers(1, 20))
def test_balls_hold_their_rows_and_searches_find_the_best(seed, n, width, leaf, k):
    r = np.random.default_rng(seed)
    x = np.floor(r.choice([0, 1, 1e6], (n, width)) * r.random((n, width)))
    x[: n // 3] = x[0]
    row, columns = np.nonzero(x)
    tree = ball_tree.Tree(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), columns, x[row, columns], width, leaf)
    queries = np.floor(r.choice([0, 1, 25000], (5, width)) * r.random((5, width)))
    exact = (queries @ x.T).astype(np.int64)
    bounds = tree.bounds(queries)
    assert all((bounds[:, i] >= exact[:, tree.order[a:b]].max(1)).all() for i, (a, b) in enumerate(tree.runs))
    best = np.zeros((5, k), np.int64)
    found = [set() for _ in range(5)]
    for q, rows, scores in tree.search(queries, best):
        assert (scores == exact[q, rows]).all()
        for i, j in zip(q.tolist(), rows.tolist()):
            found[i].add(j)
    for q in range(5):
        want = sorted(exact[q][exact[q] > 0], reverse=True)[:k]
        assert [s for s in sorted(best[q], reverse=True) if s] == want
        assert {j for j in range(n) if want and exact[q, j] >= want[-1]} <= found[q]


def test_a_subtree_out_of_reach_is_not_scored(monkeypatch):
    x = np.zeros((64, 2))
    x[:32, 0], x[32:, 1] = np.arange(1000, 1032), np.arange(1, 33)
    row, columns = np.nonzero(x)
    tree = ball_tree.Tree(np.arange(65), columns, x[row, columns], 2, 4)
    seen, scores = [], tree.scores
    monkeypatch.setattr(tree, "scores", lambda node, q: seen.append(node) or scores(node, q))
    list(tree.search(np.array([[1.0, 0.0]]), np.zeros((1, 3), np.int64)))
    assert len(seen) <= 2
