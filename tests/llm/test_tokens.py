"""Encoding, packing and packed files against the tokenizer library and plain checks."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_samples import ODD
from weir.llm import best_fit_packing, bpe, pieces, token_output


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(bpe.vocabulary_at(vocabulary))


def test_every_character_encodes_as_the_library_does(library, encoder):
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 4000):
        texts = ["x" + chr(c) + "y'" + chr(c) + "s" for c in points[a:a + 4000]]
        ids, offsets = encoder.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst' 's<|>1")), max_size=90),
                min_size=1, max_size=4))
def test_any_text_encodes_as_the_library_does(library, encoder, texts):
    ids, offsets = encoder.encode(texts)
    for text, x, y in zip(texts, offsets[:-1], offsets[1:]):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[x:y].tolist() == want
        assert encoder.decode(ids[x:y]) == library.decode(want, skip_special_tokens=False)


def test_long_words(library, encoder):
    for text in ("a" * 3000, "ab" * 900 + "'s" + "é" * 500, "!" * 700, "ing" * 400 + "<|startoftext|>" + "z" * 65):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_of_a_megabyte(encoder):
    import random
    import time
    r = random.Random(2)
    word, start = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000)), time.time()
    ids, _ = encoder.encode([word])
    assert time.time() - start < 60 and encoder.decode(ids).replace(" ", "").replace("</w>", "") == word


def test_digests_of_odd_documents(documents, library, vocabulary):
    got = sorted(tuple(r)[1:] for r in bpe.encode_digests(documents(ODD), vocabulary).collect())
    want = []
    for _, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(documents(ODD), vocabulary).count() == len(ODD)
    assert bpe.encode_digests(documents([]), vocabulary).collect() == []


def test_packing_of_odd_documents(documents, library, vocabulary):
    rows = best_fit_packing.pack_documents(documents(ODD), vocabulary, capacity=64).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id, text in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want = sorted((k // 64, k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64))
        copies = sum(x == (doc_id, text) for x in ODD)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[doc_id]) == sorted(want * copies)
    assert best_fit_packing.pack_documents(documents([]), vocabulary).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1), st.sampled_from(["large", "decreasing"]))
def test_plans_place_every_piece_once(counts, kind):
    plan = (best_fit_packing.large_item_plan if kind == "large" else token_output.best_fit_decreasing)(counts, 60)
    bins, placed = defaultdict(list), defaultdict(set)
    for length, rank, first, copies, offset, n in plan.runs:
        for i in range(n):
            placed[length].add(rank + i)
            bins[first + i // copies].append((offset + i % copies * length, length))
    assert {k: set(range(v)) for k, v in counts.items()} == dict(placed)
    assert len(bins) == plan.bins
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
        assert kind != "large" or sum(3 * n > 60 for _, n in parts) <= 2
    total, lower = sum(k * v for k, v in counts.items()), sum(v for k, v in counts.items() if 2 * k > 60)
    assert plan.bins <= max(-(-total // 60), lower) * 1.5 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(1, 30))
def test_capacity_tree_finds_the_tightest_gap(gaps, length):
    tree = pieces.CapacityTree(30)
    for i, g in enumerate(gaps):
        tree.add(g, i, 1, 0)
    assert tree.fit(length) == min((g for g in gaps if g >= length), default=0)


def test_written_matrices_give_the_texts_back(documents, library, vocabulary, tmp_path):
    rows = token_output.write_packed(documents(ODD), str(tmp_path / "packed"), vocabulary, capacity=128, pad_id=5)
    found = defaultdict(list)
    for r in rows.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens:] == 5).all() and (places[r.n_tokens:] == 0).all()
        for a, b, doc_id, piece, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, r.starts):
            assert places[a:b].tolist() == list(range(b - a))
            found[doc_id].append((piece, start, ids[a:b].tolist()))
    for doc_id, text in dict(ODD).items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(found[doc_id])
        assert {s for _, s, _ in parts} == set(range(0, len(ids), 128))
        assert [x for p in sorted({(p, tuple(v)) for p, _, v in parts}) for x in p[1]] == ids
    assert token_output.digests(rows).count() == rows.count()
    assert token_output.write_packed(documents([]), str(tmp_path / "none"), vocabulary).collect() == []


def test_a_worker_holds_little_while_it_encodes(spark, vocabulary):
    """The pipeline's packing starts when an executor's memory is at its highest."""
    import tracemalloc

    from llm_samples import prose
    from weir.llm.common import bounded_batches
    texts, encoder = [prose(400, i) for i in range(800)], bpe.Encoder(bpe.vocabulary_at(vocabulary))
    tracemalloc.start()
    try:
        for _, part in bpe.text_slices(texts):
            encoder.encode(part)
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
    finally:
        tracemalloc.stop()
    bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
