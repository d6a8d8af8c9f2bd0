"""Phrases against plain Python, and the runs of sorted windows over any batches and partitions."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_samples import ODD
from weir.llm import collocations


def phrases(rows, least, top, covered=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    inside = Counter()
    for p, c in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inside[(p[0], *p[i:i + k])] = max(inside[(p[0], *p[i:i + k])], c)
    out = {}
    for p, a in candidates.items():
        if 100 * inside[p] >= covered * a:
            continue
        cuts = [(2000000 * a // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items()
                  for r, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def spoken(seed, n=400, vocabulary=12):
    r = random.Random(seed)
    return "".join(r.choice(["Aa", "b", "a\x01", "a\x00", "é", "ab", "\U0001f600", "a\x7f", "c\xa0", "B"][:vocabulary]) + r.choice(
        [" ", " ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for _ in range(n))


@pytest.mark.parametrize("least,top,partitions", [(2, 50, 8), (5, 7, 3)])
def test_phrases_of_odd_tables(spark, documents, least, top, partitions):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(spoken(s, 60 * s), lang) for s in range(8) for lang in ("en", None, "x y\t")])]
    rows += [(1, t, "de") for _, t in ODD] + [(900 + i, "one very common line of words", "en") for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collocations.collocations(documents(rows).repartition(4), least, top)
        assert sorted(map(tuple, got.collect())) == phrases([(lang, t) for _, t, lang in rows], least, top)
        assert collocations.collocations(documents([]), least).collect() == []
        assert collocations.collocations(documents([(1, None), (2, " . ")]), least).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_scores_of_large_counts_are_exact(spark):
    a, both = 4 * 10**18 + 1, 9 * 10**18
    expr = f"(CAST(2000000 AS DECIMAL(10, 0)) * CAST({a}L AS DECIMAL(20, 0))) div (CAST({both}L AS DECIMAL(20, 0)) + {both}L)"
    assert spark.sql(f"SELECT {expr}").first()[0] == 2000000 * a // (2 * both)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["de", "en"]), st.lists(st.sampled_from(["a", "ab", "b", "é"]), min_size=1, max_size=4)), min_size=1, max_size=60),
       st.integers(1, 4), st.lists(st.integers(1, 9), min_size=60, max_size=60), st.integers(1, 3))
def test_runs_of_any_batches_add_up(rows, least, cuts, partitions):
    rows = sorted((lang, "\0".join(w)) for lang, w in rows)
    want = Counter((lang, k[:len(p)]) for lang, k in rows for n in range(1, 5) if len(p := "\0".join(k.split("\0")[:n])) and k.count("\0") >= n - 1)
    got, size = Counter(), -(-len(rows) // partitions)
    for a in range(0, len(rows), size):
        part, runs, at = rows[a:a + size], collocations.Runs(least), 0
        found = []
        for n in cuts:
            if at >= len(part):
                break
            own = part[at:at + n]
            found += runs.add(pa.array([x for x, _ in own]), pa.array([x for _, x in own]), pa.array([1] * len(own)).to_numpy())
            at += n
        for lang, key, n, f, edge in found + runs.end():
            assert edge or f >= least
            got[lang, key.tobytes().decode()] += f
            assert key.tobytes().decode().count("\0") == n - 1
    assert {k: v for k, v in got.items() if v >= least} == {k: v for k, v in want.items() if v >= least}
