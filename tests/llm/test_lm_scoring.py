"""Scores against the counts they rest on, and what a language model has to do."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_samples import ODD, prose, tokens
from weir.llm import lm_scoring as L


def check(rows, found):
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            counts.update(tokens(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want, got = [], []
    for d, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        want.append((str(d), zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, len(own), sum(counts[x] > 0 for x in own), n,
                     round(base, 5)))
    for r in found:
        assert math.isfinite(r.score) and r.score <= 0 and r.bits_per_byte >= 0
        got.append((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)))
    for a, b in zip(sorted(want), sorted(got)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-5)
    assert len(want) == len(got)


def test_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], L.score_documents(docs).collect())


def test_frequent_and_joined_words_give_the_same_scores(documents):
    rows = ODD + [(20 + i, prose(80, i)) for i in range(60)]
    a = L.score_documents(documents(rows)).orderBy("doc_id", "score").collect()
    b = L.score_documents(documents(rows), head_words=0).orderBy("doc_id", "score").collect()
    check(rows, a)
    check(rows, b)
    assert [r.score for r in a] == pytest.approx([r.score for r in b], rel=1e-5)


def test_empty_and_untrained(documents):
    assert L.score_documents(documents([])).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "never seen words") for i in held]
    found = L.score_documents(documents(rows)).collect()
    assert {r.base_score for r in found} == {0.0} and {r.train_tokens for r in found} == {0} and all(r.score < 0 for r in found)


def test_held_out_texts_of_the_corpus_score_above_noise(documents):
    rows = [(i, prose(150, i, 60)) for i in range(300)]
    rows += [(1000 + i, "".join(chr(97 + (i * 7 + j * j) % 26) if j % 6 else " " for j in range(900))) for i in range(40)
             if zlib.crc32(str(1000 + i).encode()) % 5 == 1]
    found = L.score_documents(documents(rows)).collect()
    good = [r.score / r.n_tokens for r in found if r.held_out and r.doc_id < 1000]
    noise = [r.score / r.n_tokens for r in found if r.doc_id >= 1000]
    assert noise and min(good) > max(noise)


def test_spellings_sum_to_one():
    """All words of one letter or none, and the share of longer ones that the first letters leave."""
    words = [b"ab", b"abc", b"ba", b"bab", b"cab", b"caab"] * 5
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))
    model = L.Spelling(np.bincount(data, minlength=256))
    slots, _, bit, _, _ = model.events(data, offsets)
    for k in range(len(L.ORDERS)):
        for b in (0, 1):
            model.seen[k, b] = np.bincount(slots[k][bit == b], minlength=L.SLOTS)
    before = model.log10(data, offsets).sum()
    for _ in range(20):
        model.learn(data, offsets)
    assert model.log10(data, offsets).sum() > before
    singles = [bytes([c]) for c in range(256) if c != L.END]
    one = np.frombuffer(b"".join(singles), np.uint8), np.arange(len(singles) + 1)
    total = (10 ** model.log10(*one)).sum() + (10 ** model.log10(np.zeros(0, np.uint8), np.array([0, 0]))).sum()
    assert 0 < total < 1


def test_large_counts_keep_their_shares():
    own = np.array([[300_000, 100_000], [5, 7], [0, 0], [10_000_000, 1], [65_535, 2]], np.int64)
    got = np.frombuffer(L._part(3, own.ravel()).column(1)[0].as_py(), np.uint16).reshape(-1, 2)
    assert got.tolist() == [[65535, 21845], [5, 7], [0, 0], [65535, 1], [65535, 2]]


def test_a_very_long_word_is_spelled_in_bounded_runs(documents):
    import pyarrow as pa
    words_ = [b"ab", b"x" * (3 * L.CHUNK_BYTES + 5), b"", b"cd", b"y" * L.CHUNK_BYTES]
    parts = list(L.chunks(pa.array(words_).slice(1)))
    assert all(len(d) <= L.CHUNK_BYTES for _, d, _ in parts)
    back = [b""] * 4
    for of, data, offsets in parts:
        for i, a, b in zip(of, offsets[:-1], offsets[1:]):
            back[i] += data[a:b].tobytes()
    assert back == words_[1:] and list(L.chunks(pa.array([], pa.binary()))) == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = {r.doc_id: r for r in L.score_documents(documents([(held[0], "z" * 600_000), (held[1], "zz"), (1, "some words")])).collect()}
    assert got[held[0]].score < got[held[1]].score < 0 and got[held[0]].n_known == 1


def test_without_training_documents(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = L.score_documents(documents([(held, "two words")])).collect()[0]
    assert row.train_tokens == 0 and row.n_known == 0 and row.score < np.log10(0.5)


def test_the_order_of_words_has_a_part_in_the_score(documents):
    """Every noun is followed by its own verb; a held-out text in that order is likelier than its words in another one."""
    import random
    r = random.Random(5)

    def text(n):
        return " ".join(f"noun{k} verb{k}" for k in (r.randrange(40) for _ in range(n)))

    held = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 5 == 1][:10]
    rows, mixed = [(i, text(60)) for i in range(400)], {}
    for a, b in zip(held[::2], held[1::2]):
        pairs = r.sample(range(40), 30)  # no word twice, so that the words of the document itself do not matter
        rows += [(a, " ".join(f"noun{k} verb{k}" for k in pairs)),
                 (b, " ".join([f"verb{k}" for k in pairs] + [f"noun{k}" for k in reversed(pairs)]))]
        mixed[a] = b
    found = {x.doc_id: x for x in L.score_documents(documents(rows)).collect()}
    for a, b in mixed.items():
        assert found[a].base_score == pytest.approx(found[b].base_score)
        assert found[a].score > found[b].score + 20 and found[a].score > found[a].base_score + 20


def running(texts, learnt=3):
    """A model of the running text of lists of words, fitted without Spark, its words, and the parts that its methods take."""
    from weir.llm.arrays import SpanHasher, words
    lines = [" ".join(t).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(lines), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    starts, ends, per_text = words(data, offsets)
    h = SpanHasher()(data, starts, ends)
    own = {data[a:b].tobytes(): x for a, b, x in zip(starts, ends, h)}
    counts = Counter(w.encode() for t in texts for w in t)
    known = sorted(w for w, c in counts.items() if c > 1)
    m = L.Running(np.array([own[w] for w in known], np.uint64),
                  np.array([sum(c for c in counts.values() if c == 1), len(texts), *(counts[w] for w in known)], float), 16)
    parts = m.text(data, starts, ends, per_text, h, L.Codes(m.hashes)(h))
    seen = np.zeros((L.CONTEXTS, 1 << 16, 2), np.uint16)
    for _, _, _, _, bit, slots in m.blocks(*parts[:2]):
        for k in range(L.CONTEXTS):
            np.add.at(seen[k], (slots[k], bit.astype(int)), 1)
    m.seen = seen.view(np.uint32)[..., 0]
    for _ in range(learnt):
        m.learn(*parts[:2], np.zeros((L.CONTEXTS + 2, L.STEERS)))
    return m, known, parts


def test_the_symbols_after_a_word_sum_to_one():
    r = np.random.default_rng(3)
    m, known, (contexts, symbol, _, last) = running([[f"w{int(x) % 97}" for x in r.zipf(1.3, 50)] for _ in range(60)])
    n = len(known) + 2
    for at in (0, 1, 7, int(last[0]), int(last[3]) + 1, len(symbol) - 1):
        p = 10 ** m.log10([np.repeat(c[at:at + 1], n) for c in contexts], np.arange(n))
        assert p.min() > 0 and p.sum() == pytest.approx(1, abs=1e-4)


def test_contexts_are_the_words_and_bytes_before_and_end_with_the_text():
    m, known, (contexts, symbol, at, last) = running([["ab", "xcd", "ab"], [], ["ab"], ["q", "yxcd", "ab"], ["xcd", "ab"]])
    assert known == [b"ab", b"xcd"] and symbol.tolist() == [2, 3, 2, 1, 1, 2, 1, 0, 0, 2, 1, 3, 2, 1]
    assert last.tolist() == [3, 4, 6, 10, 13] and [int(x) for x in at if x not in last] == at.tolist()
    two, four, word, words_ = (c.tolist() for c in contexts)
    for c in (two, four, word, words_):
        assert len({c[i] for i in (0, 4, 5, 7, 11)}) == 1  # the beginnings of texts
    assert two[2] == two[9] and four[2] != four[9] and word[2] != word[9]  # after xcd and yxcd
    assert four[2] == four[12] and word[2] == word[12] and words_[2] != words_[12]  # ab xcd, and xcd as the first word
    assert word[1] == word[3] == word[6] and words_[1] == words_[6] != words_[3]


def test_codes_follow_the_order_of_the_symbols_and_keep_their_shares():
    counts = np.array([40, 3, 900, 1, 1, 1, 55, 200, 0.5, 7] * 30, float)
    (first, length, nodes, bits, groups, places), ones, rest = L.alphabetic(counts)
    codes = [tuple(bits[a:a + n].tolist()) for a, n in zip(first, length)]
    assert codes == sorted(codes) and len(np.unique(np.stack([groups, places]), axis=1).T) == len(np.unique(nodes))
    p = [np.prod([ones[k] if b else 1 - ones[k] for k, b in zip(nodes[a:a + n], bits[a:a + n])]) for a, n in zip(first, length)]
    assert p * rest == pytest.approx(counts / counts.sum())
    assert 1 <= places.min() and places.max() <= 15
