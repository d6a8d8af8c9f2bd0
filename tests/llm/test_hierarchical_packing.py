"""Windows of several lengths against the tokenizer library and plain checks."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_samples import ODD
from weir.llm import hierarchical_packing as packing


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def whole(windows, lengths, tiers):
    """Every token once, every window full, of a tier or, once each, of a power of two."""
    seen, odd = defaultdict(list), []
    for size, window in windows:
        assert sum(n for _, _, n in window) == size and all(n > 0 for _, _, n in window)
        if size not in tiers:
            odd.append(size)
        for doc, at, n in window:
            seen[doc].append((at, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n
    assert len(odd) == len(set(odd)) and all(x & (x - 1) == 0 for x in odd)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80), st.sampled_from([(64, 32, 16, 8), (64,), (64, 8), (16, 8, 4, 2, 1)]), st.integers(1, 300))
def test_blocks_hold_every_token_once_without_padding(lengths, tiers, step):
    windows = packing.pack_block(lengths, tiers)
    whole(windows, lengths, tiers)
    groups = packing.step_groups(windows, step)
    tokens = defaultdict(int)
    for (size, _), g in zip(windows, groups):
        tokens[g] += size
    if windows:
        assert max(tokens.values()) - min(tokens[g] for g in range(max(1, round(sum(lengths) / step)))) <= tiers[0]


def test_documents_go_to_their_tier_and_gaps_take_shorter_ones():
    windows = packing.pack_block([60, 40, 30, 20, 10, 4, 3, 1], (64, 32, 16))
    assert windows[0] == (64, [(0, 0, 60), (5, 0, 4)]) and windows[1][1][:2] == [(1, 0, 40), (3, 0, 20)]
    whole(windows, [60, 40, 30, 20, 10, 4, 3, 1], (64, 32, 16))


def test_groups_of_equal_windows_share_the_cost():
    windows = [(64, [(i, 0, 64)]) for i in range(8)] + [(64, [(i, k, 8) for k in range(0, 64, 8)]) for i in range(8, 16)]
    groups, cost = packing.step_groups(windows, 256), defaultdict(int)
    for (_, window), g in zip(windows, groups):
        cost[g] += sum(n * n for _, _, n in window)
    assert len(cost) == 4 and max(cost.values()) == min(cost.values())


@pytest.mark.parametrize("block", [100, 1 << 22])
def test_pieces_of_odd_documents(documents, path, block):
    library = Tokenizer.from_file(path)
    rows = ODD + [(20, "it's <|endoftext|>  two\n\n\tthree   é\U0001f600"), (21, "   "), (22, "x" * 3000)]
    got = packing.pack_documents(documents(rows), path, tiers=(64, 32, 16), block_tokens=block).collect()
    want = sorted(([*library.encode(text or "", add_special_tokens=False).ids, 0] for _, text in rows))
    own, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.tier <= 64
        own[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    for parts in windows.values():
        at = 0
        for offset, length, tier, group in sorted(parts):
            assert offset == at and (tier, group) == parts[0][2:]
            at += length
        assert at == parts[0][2]
    ids = dict(rows)
    for doc_id, parts in own.items():
        if doc_id != 8:  # which is there twice
            assert [x for _, p, _ in sorted(parts) for x in p] == [*library.encode(ids[doc_id] or "", add_special_tokens=False).ids, 0]
            assert {total for _, _, total in parts} == {sum(len(p) for _, p, _ in parts)}
    assert sum(len(p) for parts in own.values() for _, p, _ in parts) == sum(map(len, want))
    digests = packing.digests(packing.pack_documents(documents(rows), path))
    assert "ids" not in digests.columns and digests.where("ids_crc32 IS NULL").count() == 0
    assert packing.pack_documents(documents([]), path).collect() == []


def test_every_character_encodes_as_the_library_does(path):
    library, own = Tokenizer.from_file(path), packing.byte_encoding(*packing.byte_vocabulary(path))
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 8000):
        texts = ["x" + chr(c) + " " + chr(c) + "1" + chr(c) + "! '" + chr(c) + "s  " + chr(c) for c in points[a:a + 8000]]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [own.encode(t, allowed_special="all") for t in texts] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst' 's<|>1\n")), max_size=90))
def test_any_text_encodes_as_the_library_does(path, text):
    library, own = Tokenizer.from_file(path), packing.byte_encoding(*packing.byte_vocabulary(path))
    assert own.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_tiers_are_falling_powers_of_two(documents, path):
    for tiers in ((64, 64), (32, 64), (48,), ()):
        with pytest.raises((ValueError, IndexError)):
            packing.pack_documents(documents([]), path, tiers).collect() or packing.pack_block([1], tiers)
