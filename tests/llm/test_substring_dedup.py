"""Repeated passages against every run of 50 equal words, and on edited passages."""

import random

from llm_samples import ODD, prose, tokens
from weir.llm import substring_dedup as S


def exact(rows, k=50):
    """Words of each id that lie in a run of k words that a smaller id has too."""
    first, out = {}, {}
    docs = sorted((d, tokens(t)) for d, t in rows)
    for d, w in docs:
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p:p + k]), d)
    for d, w in docs:
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < d:
                out.setdefault(d, set()).update(range(p, p + k))
    return out


def covered(found):
    out = {}
    for r in found:
        assert r.passage_end - r.passage_start >= 50 and r.ref_doc_id < r.doc_id
        assert r.passage_start <= r.start_word < r.end_word <= r.passage_end and r.identity >= 0.75
        out.setdefault(r.doc_id, set()).update(range(r.passage_start, r.passage_end))
    return out


def test_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = exact(rows), covered(S.repeated_passages(docs).collect())
    assert want and all(want[d] <= got.get(d, set()) for d in want)


def test_planted_passages_and_clean_documents(documents):
    r = random.Random(4)
    passage = prose(51, 77, 4000)
    fuzzy = passage.split()
    for i in (9, 24, 40):
        fuzzy[i] = f"other{i}"
    del fuzzy[30]
    short = prose(30, 78, 4000)
    rows = []
    for i in range(30):
        own = [prose(r.randrange(60, 200), 1000 + 2 * i, 4000), prose(r.randrange(60, 200), 1001 + 2 * i, 4000)]
        middle = passage.upper() if i in (3, 8, 21) else " ".join(fuzzy) if i in (12, 25) else short if i in (5, 6, 7) else ""
        rows.append((i, f"{own[0]} {middle}\n{own[1]}"))
    got = covered(S.repeated_passages(documents(rows)).collect())
    assert set(got) == {8, 12, 21, 25}
    for d in got:
        at = len(tokens(rows[d][1].split("\n")[0])) - (len(fuzzy) if d in (12, 25) else 51)
        want = set(range(at, at + (len(fuzzy) if d in (12, 25) else 51)))
        assert len(want ^ got[d]) <= 3
    cut = {r.doc_id: r.text for r in S.without_passages(documents(rows), S.repeated_passages(documents(rows))).collect()}
    assert cut[0] == rows[0][1] and cut[3] == rows[3][1] and len(cut) == 30
    assert not set(tokens(cut[8])) & (set(tokens(passage)) - set(tokens(rows[8][1].replace(passage.upper(), ""))))


def test_odd_texts(documents):
    assert S.repeated_passages(documents(ODD)).collect() == []
    assert S.repeated_passages(documents([])).collect() == []
    rows = ODD + [(70, "word " * 9000), (71, prose(60, 1)), (71, prose(60, 1)), (72, prose(60, 1))]
    got = covered(S.repeated_passages(documents(rows)).collect())
    assert set(got) == {70, 72} and got[72] == set(range(60)) and len(got[70]) > 8980
    circle = [(i, prose(40, i) + " round and" * 90 + prose(40, 100 + i)) for i in range(2)]
    assert len(covered(S.repeated_passages(documents(circle)).collect())[1]) > 170
    left = S.without_passages(documents(rows), S.repeated_passages(documents(rows)))
    assert left.columns == documents(rows).columns and 72 not in {r.doc_id for r in left.collect()}
    assert left.filter("doc_id is null or doc_id = 1").count() == 2


def test_chains_follow_both_orders():
    import numpy as np
    parts = np.array([[0, 10, 100, 110], [12, 20, 50, 58], [15, 25, 115, 125], [30, 36, 131, 137], [200, 210, 140, 150]])
    assert S.chains(parts) == [[0, 2, 3], [4], [1]]


def test_a_far_passage_hides_no_near_run(documents):
    import numpy as np
    parts = np.array([[0, 300, 0, 300], [400, 412, 400, 412], [413, 425, 414, 426], [426, 438, 428, 440]])
    assert S.chains(parts) == [[0], [1, 2, 3]]
    first, second = prose(300, 900, 4000), prose(60, 901, 4000).split()
    broken = [w for i in range(0, 60, 12) for w in [*second[i:i + 12], f"put{i}"]]
    rows = [(i, " ".join([first, prose(100, 910 + i, 4000), *(second if i == 1 else broken)])) for i in (1, 2)]
    got = covered(S.repeated_passages(documents(rows)).collect())
    assert set(range(300)) | set(range(400, 464)) <= got[2]


def test_a_passage_is_found_wherever_its_seeds_are_at_home(documents):
    passage = prose(70, 950, 4000).split()
    edited = passage[:17] + ["other"] + passage[18:44] + passage[45:]
    for often in (1, 12):  # few places of a seed, and many
        rows, d = [(10_000, " ".join([prose(90, 951, 4000), *passage])), (20_000, " ".join([*passage, prose(80, 952, 4000)])),
                   (30_000, " ".join([*edited, prose(80, 953, 4000)]))], 0
        for p in range(0, 66):  # every seed stands alone in earlier documents
            for _ in range(often):
                rows.append((d, " ".join([prose(20, 2000 + 2 * d, 4000), *passage[p:p + 5], prose(20, 2001 + 2 * d, 4000)])))
                d += 1
        got = covered(S.repeated_passages(documents(rows)).collect())
        assert got.pop(20_000) == set(range(70))
        assert often > 1 or len(got.pop(30_000) ^ set(range(69))) <= 2
        assert often > 1 or not got


def test_recall_of_edited_passages(documents):
    r, rows, want = random.Random(8), [], {}
    for case, share in enumerate([0, 25, 20, 15, 10] * 12):
        passage = prose(60, 3000 + case, 4000).split()
        if share:
            gone = set(r.sample(range(60), 60 * share // 100))
        else:
            gone = set(range(5, 60, 6))
        edited = [f"put{case}x{i}" if i in gone else w for i, w in enumerate(passage)]
        for d, own in ((2 * case, passage), (2 * case + 1, edited)):
            rows.append((d, " ".join([prose(70, 5000 + 2 * d, 4000), *own, prose(70, 5001 + 2 * d, 4000)])))
        kept = [i not in gone for i in range(60)]
        if any(kept[a] and kept[b - 1] and 100 * sum(kept[a:b]) >= 75 * (b - a) for a in range(11) for b in range(a + 50, 61)):
            want[2 * case + 1] = share
    got = covered(S.repeated_passages(documents(rows)).collect())
    assert set(got) <= set(want) and len(want) > 50
    lost = {d: s for d, s in want.items() if d not in got}
    assert not lost
    assert all(len(got[d] & set(range(70, 130))) >= 50 for d in got)


def test_passages_with_unshared_words_between(documents):
    """Exact runs A and B with other words between: both are found whole, and no long stretch of what is not shared."""
    r, rows, want, case = random.Random(5), [], {}, 0
    word = lambda: f"own{r.randrange(1 << 40)}"
    for gap, other in [(10, 10), (16, 16), (17, 17), (30, 30), (45, 45), (60, 60), (64, 64), (20, 0), (0, 20), (12, 40), (40, 12)]:
        for a, b in [(50, 50), (60, 60), (80, 80), (100, 100), (120, 50), (50, 120)]:
            first, second = prose(a, 9000 + 2 * case, 4000).split(), prose(b, 9001 + 2 * case, 4000).split()
            edge = [[word() for _ in range(20)] for _ in range(4)]
            gaps = [word() for _ in range(gap)], [word() for _ in range(other)]
            rows.append((2 * case, " ".join([*edge[0], *first, *gaps[0], *second, *edge[1]])))
            rows.append((2 * case + 1, " ".join([*edge[2], *first, *gaps[1], *second, *edge[3]])))
            want[2 * case + 1] = set(range(20, 20 + a)) | set(range(20 + a + other, 20 + a + other + b))
            case += 1
    got = covered(S.repeated_passages(documents(rows)).collect())
    assert got == want


def brute_chains(parts):
    """Scores of the best chain that ends at each run, all predecessors tried."""
    score = []
    for i, (q0, q1, r0, _) in enumerate(parts):
        best = max([s + S.GAP * (e[1] + e[3]) for s, e in zip(score, parts) if q0 - S.REACH <= e[1] <= q0 and r0 - S.REACH <= e[3] <= r0],
                   default=-1e18) - S.GAP * (q0 + r0)
        score.append(q1 - q0 + max(best, 0))
    return score


def test_chains_against_all_predecessors():
    import numpy as np
    r = random.Random(6)
    for size in [2, 5, 40, 150] * 6:
        q, ref = [r.randrange(size * 6) for _ in range(size)], [r.randrange(size * 6) for _ in range(size)]
        n = [r.randrange(5, 60) for _ in range(size)]
        parts = np.array(sorted((a, a + k, b, b + k) for a, b, k in zip(q, ref, n)))
        rows, score = parts.tolist(), brute_chains(parts.tolist())
        got = S.chains(parts)
        assert sorted(i for c in got for i in c) == list(range(size))
        top = rows[0][1] - rows[0][0] if size == 1 else sum(
            rows[i][1] - rows[i][0] - (S.GAP * (rows[i][0] - rows[j][1] + rows[i][2] - rows[j][3]) if j is not None else 0)
            for i, j in zip(got[0], [None, *got[0][:-1]]))
        assert abs(top - max(score)) < 1e-9
        for chain in got:
            for i, j in zip(chain[1:], chain[:-1]):
                assert 0 <= rows[i][0] - rows[j][1] <= S.REACH and 0 <= rows[i][2] - rows[j][3] <= S.REACH


def test_packed_places_are_whole_and_small():
    import numpy as np
    import zlib

    r = np.random.default_rng(1)
    n = 40_000
    seed, doc = r.integers(0, 1 << 64, n, np.uint64), np.sort(r.integers(-5, 200, n)) << 33
    pos, size = np.arange(n, dtype=np.int32) % 300, np.full(n, 5, np.int32)
    batch = S.packed(seed, doc, pos, size, 7)
    x = np.concatenate([S.unpacked(p) for p in batch.column(1).to_pylist()])
    assert sorted(x.tolist()) == sorted(zip(seed.tolist(), doc.tolist(), pos.tolist(), size.tolist())) and batch.column(0).to_pylist() == list(range(7))
    assert sum(len(zlib.compress(p, 1)) for p in batch.column(1).to_pylist()) < 10 * n
    assert len(S.packed(seed[:0], doc[:0], pos[:0], size[:0], 7)) == 0


def test_the_bound_of_a_stretch_is_no_shorter():
    import numpy as np

    r = np.random.default_rng(2)
    for share in (2, 3, 12):
        q, other = (r.integers(0, share, (300, S.STRETCH), np.uint32) for _ in range(2))
        n = r.integers(0, S.STRETCH + 1, 300)
        four = [(x & 15).astype(np.uint8) for x in (q * 7, other * 7)]
        got = S.longest_stretch(*(x[:, ::2] | x[:, 1::2] << 4 for x in four), n)
        assert all(g >= S.stretch(a[:m], b[:m])[0] for g, a, b, m in zip(got, q, other, n)) and (got <= n).all()


def test_chains_that_can_make_no_passage_are_not_aligned(documents):
    """Matches are packed, and of many chance matches only the chains of passages are aligned; the passages are the same."""
    r = random.Random(9)
    text = lambda n: " ".join(f"word{r.randrange(60)}" for _ in range(n))
    rows = [(i, text(300)) for i in range(60)]
    rows += [(100 + i, " ".join([text(40), *rows[i][1].split()[50:120], text(40)])) for i in range(6)]
    docs = documents(rows).selectExpr("doc_id as doc", "text")
    found = S.matched(docs, 2, 50)
    assert found.columns == ["part", "found"]
    columns = [S.undealt([r.found], S.MATCH) for r in found.collect()]
    size, n = sum(len(r.found) for r in found.collect()), sum(len(c[0]) for c in columns)
    assert 0 < size < 10 * n, (size, n)  # a row of such a match takes 48 bytes
    chains = S.chained(found).localCheckpoint()
    kept = S.promising(docs, chains, 50).localCheckpoint()
    assert 6 <= kept.count() < chains.count() / 5
    both = [S.in_passages(S.aligned(docs, c, 75), 50).drop("_new", "_island") for c in (chains, kept)]
    want, got = (sorted(map(tuple, d.collect()), key=str) for d in both)
    assert got == want and {r[0] for r in got} >= set(range(100, 106))
