"""Near-duplicates against all pairs of shingle sets."""

import random
from collections import Counter, defaultdict

import numpy as np

from llm_samples import ODD, prose, tokens
from weir.llm import near_duplicates as N
from weir.llm.components import components


def shingle_set(text, k=5):
    w = tokens(text)
    return frozenset(" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=75):
    """(number of shingles, smallest id reachable) of each (id, text)."""
    sets, where = [shingle_set(t) for _, t in rows], defaultdict(list)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((str(d), len(sets[i]), None if d is None else least[root(i)], d is None or d == least[root(i)])
                  for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect())


def test_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(documents):
    assert got(documents(ODD)) == brute(ODD)
    assert got(documents([])) == []


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{seed}n{i}"
    return " ".join(w)


def test_groups_whose_members_are_only_linked_through_others(documents):
    base = prose(120, 5)
    # copies with three edits each: near to the base, often not to each other; chains of texts that drift apart
    rows = [(1000, base)] + [(i, edited(base, 3, i)) for i in range(40)]
    text = prose(90, 9)
    for i in range(12):
        rows.append((500 - i, text))
        text = edited(text, 2, 7000 + i)
    rows += [(2000 + i, prose(6 + i % 3, 50 + i // 3)) for i in range(30)]  # short sets, 3 to 4 shingles
    rows += [(3000 + i, base.upper() if i % 2 else base + "\n") for i in range(20)]
    assert got(documents(rows)) == brute(rows)


def test_a_bucket_of_many_components_is_finished(documents, monkeypatch):
    """With one row a band, buckets hold texts of every kind and need many centres."""
    monkeypatch.setattr(N, "BANDS", 8)
    monkeypatch.setattr(N, "ROWS", 1)
    half = prose(40, 3)
    rows = [(i, half + " " + prose(25, 100 + i // 2) + (" x" if i % 2 else "")) for i in range(50)]
    assert got(documents(rows)) == brute(rows)


def test_signatures_agree_as_often_as_sets():
    r = np.random.default_rng(1)
    for size in (3, 60, 900):
        same, n = 0, 200
        for _ in range(n):
            union = r.integers(0, 2**63, size * 2, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(union[:int(1.6 * size)]), np.sort(union[int(0.4 * size):])
            sig = N.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 128)
            same += (sig[0] == sig[1]).mean()
        share = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs(same / n - share) < 0.04


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103)]
    random.Random(2).shuffle(chain)
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 105: 100, 103: 100}


def test_odd_sketches_leave_out_pairs_below_the_limit_and_none_above():
    r = np.random.default_rng(4)
    passed = {}
    for n in (1, 7, 40, 150, 900, 20_000):
        for share in (0.5, 0.65, 0.7, 0.75, 0.8, 1.0):
            both = int(np.ceil(2 * n * share / (1 + share)))
            x = r.integers(0, 1 << 64, 2 * n, np.uint64)
            a, b = x[:n], x[n - both:2 * n - both]
            odd = N.odd_sketch(np.concatenate((a, b)), np.array([0, n, 2 * n]))
            assert odd.shape == (2, N.ODD // 64)
            differ = int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum())
            assert differ <= 2 * (n - both)
            passed[n, share] = differ * 175 <= 2 * n * 25
            assert passed[n, share] or 100 * both < 75 * (2 * n - both)
    assert not passed[150, 0.5] and not passed[150, 0.65] and not passed[150, 0.7] and not passed[40, 0.65]
    assert not N.odd_sketch(np.zeros(0, np.uint64), np.array([0, 0])).any()


def test_signatures_are_made_in_bounded_runs():
    import pyarrow as pa
    from weir.llm.arrays import SpanHasher, slices
    texts = pa.array([prose(12, i) if i % 7 else None for i in range(3 * N.RUN + 5)])
    runs, whole = list(N.set_runs(texts, SpanHasher(), 5)), []
    assert len(list(slices(texts))) == 1 and all(hi - lo <= N.RUN for lo, hi, _, _ in runs)
    _, _, data, offsets = next(slices(texts))
    h, at = N.document_sets(data, offsets, SpanHasher(), 5)
    assert [lo for lo, _, _, _ in runs] == [0, *(hi for _, hi, _, _ in runs)][:-1] and runs[-1][1] == len(texts)
    for lo, hi, own, own_at in runs:
        whole += [own[a:b].tolist() for a, b in zip(own_at[:-1], own_at[1:])]
    assert whole == [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
