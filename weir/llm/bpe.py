"""BPE encoding and decoding over word-level vocabularies.

A text is normalised and cut into words; each distinct word of a slice is merged once. The words of one length class stand in
a matrix: a row holds the parts of a word and beside them the rank of each adjacent pair, contiguous in memory. Each round
scans every row for its lowest rank, joins that pair, deletes the boundary and refreshes the two ranks next to it. Words over
`SHORT` bytes take the same steps from a heap, whose cost stays n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from weir.llm.arrays import SpanHasher, ragged
from weir.llm.common import Shared, bounded_batches

SHORT = 64
NO_RANK = np.int32(2**31 - 1)
#: The white space of the vocabulary's patterns, as code points.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stay with their apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
SEPARATOR = "\ud800"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def character_kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of every code point, as the tokenizer library's own patterns tell them apart."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            kinds[at[a:b]] = kind
    kinds[WHITE] = kinds[0xD800:0xE000] = SPACE
    return kinds


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file; small and picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + end] for s in symbols], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.kinds = character_kinds()
        self.newer = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 8 + 1))))
        self.slot_keys, self.slot_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # each free place goes to the first that asks; the others try the next place
            free = self.slot_keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.slot_keys[slots], self.slot_ranks[slots] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NO_RANK if they never join or one is -1."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(keys)
        found = self.slot_keys[at]
        out = np.where(found == keys, self.slot_ranks[at], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slot_keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def joins(self) -> dict[int, int]:
        """Merge rank of each pair of ids, the left one above 32 bits, for pairs looked up one by one."""
        real = self.slot_keys != -1
        return dict(zip(self.slot_keys[real].tolist(), self.slot_ranks[real].tolist()))


@lru_cache(maxsize=2)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes and decodes slices of texts. Distinct words are remembered up to a bound."""

    CACHE, STORE = 1 << 19, 1 << 22

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.library_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.hasher, self.known = SpanHasher(), None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(self.CACHE, np.uint64), np.zeros(self.CACHE, np.int64)
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # ---- words -----------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.v.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():  # characters Python does not know yet
            return self.library_normal(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # no special form at the end of a word

    def _spans(self, points: np.ndarray):
        kinds = self.v.kinds[points]
        before = np.concatenate(([SPACE], kinds[:-1])) if len(kinds) else kinds
        first = (kinds != SPACE) & ((kinds != before) | (kinds == NUMBER))
        padded, ahead = np.concatenate((points, [0, 0, 0])), np.concatenate((kinds, [SPACE] * 3))
        quotes = np.flatnonzero(first & (points == 39))
        quotes = quotes[ahead[quotes + 1] == LETTER]
        for ending in ENDINGS:
            hit = np.ones(len(quotes), bool)
            for j, c in enumerate(ending):
                hit &= padded[quotes + 1 + j] == ord(c)
            at, quotes = quotes[hit], quotes[~hit]
            first[at + 1] = False
            rest = at + 1 + len(ending)
            first[rest[ahead[rest] == LETTER]] = True
        breaks = np.flatnonzero(first | (kinds == SPACE))
        ends = np.append(breaks[1:], len(points))
        real = kinds[breaks] != SPACE if len(breaks) else np.zeros(0, bool)
        return breaks[real], ends[real]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        if any(t in x for x in texts for t in self.v.special):
            return self._with_special(texts)
        joined = SEPARATOR.join(map(self.normal, texts))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends = self._spans(points)
        per_text = np.searchsorted(starts, np.flatnonzero(points == 0xD800))
        if len(data) > len(points):  # from characters to bytes
            place = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
            starts, ends = place[starts], place[ends]
        hashes = self.hasher(data, starts, ends)
        hashes[hashes == 0] = 1
        slot = (hashes & np.uint64(self.CACHE - 1)).astype(np.int64)
        entry = self.entry[slot]
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            if len(self.ids) > self.STORE:
                self._forget()
                new = np.arange(len(hashes))
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            entry[new] = self._merge(data, starts[new[first]], ends[new[first]])[back]
            self.keys[slot[new]], self.entry[slot[new]] = hashes[new], entry[new]
        counts = self.counts[entry]
        ids = self.ids[ragged(self.starts[entry], counts)]
        running = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.concatenate(([0], running[per_text], [running[-1]]))

    def _with_special(self, texts: list[str]):
        parts, owner, found = [], [], []
        for i, text in enumerate(texts):
            at = 0
            while True:
                hits = [(p, -len(t), t) for t in self.v.special if (p := text.find(t, at)) >= 0]
                stop = min(hits) if hits else (len(text), 0, "")
                parts.append(text[at:stop[0]])
                owner.append(i)
                found.append(self.v.special[stop[2]] if hits else -1)
                if not hits:
                    break
                at = stop[0] + len(stop[2])
        ids, offsets = self.encode(parts)
        out, lengths = [], np.zeros(len(texts), np.int64)
        for j, (i, extra) in enumerate(zip(owner, found)):
            piece = ids[offsets[j]:offsets[j + 1]]
            out.append(piece if extra < 0 else np.append(piece, np.int32(extra)))
            lengths[i] += len(out[-1])
        return np.concatenate(out).astype(np.int32), np.concatenate(([0], np.cumsum(lengths)))

    # ---- merging ---------------------------------------------------------------------------------

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merges the words, stores their ids, and returns each word's place in the store."""
        sizes, place = ends - starts, np.empty(len(starts), np.int64)
        ids, counts, order = [self.ids], [self.counts], []
        low = 0
        for high in (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(rows), 20000):
                part = rows[k:k + 20000]
                merged, n = self._merge_rows(data, starts[part], sizes[part], high)
                ids.append(merged[np.arange(high) < n[:, None]])
                counts.append(n)
                order.append(part)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids.append(self._merge_long(data[starts[i]:ends[i]]))
            counts.append(np.array([len(ids[-1])]))
            order.append(np.array([i]))
        place[np.concatenate(order)] = len(self.counts) + np.arange(len(starts))
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.starts = np.cumsum(self.counts) - self.counts
        return place

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cols: int):
        n = len(starts)
        raw = data[np.minimum(starts[:, None] + np.arange(cols), len(data) - 1)]
        ids = self.v.inner[raw]
        rows = np.arange(n)
        ids[rows, sizes - 1] = self.v.last[raw[rows, sizes - 1]]
        ids[np.arange(cols) >= sizes[:, None]] = -1
        ranks = self.v.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, cols - 1)
        out, n_ids, live = ids.copy(), sizes.astype(np.int64), rows
        while len(live) and ranks.shape[1]:
            m = ranks.argmin(1)
            best = ranks[rows[:len(live)], m]
            go = best != NO_RANK
            if not go.all():
                out[live[~go], :ids.shape[1]] = ids[~go]
                live, ids, ranks, m, best = live[go], ids[go], ranks[go], m[go], best[go]
            r, wide = rows[:len(live)], ids.shape[1]
            ids[r, m] = self.v.merged[best]
            n_ids[live] -= 1
            ids = ids[np.arange(wide) != (m + 1)[:, None]].reshape(len(live), wide - 1)  # the boundary after m goes
            ranks = ranks[np.arange(wide - 1) != m[:, None]].reshape(len(live), wide - 2)
            right, left = m < wide - 2, m > 0
            ranks[r[right], m[right]] = self.v.ranks(ids[r[right], m[right]], ids[r[right], m[right] + 1])
            ranks[r[left], m[left] - 1] = self.v.ranks(ids[r[left], m[left] - 1], ids[r[left], m[left]])
        out[live, :ids.shape[1]] = ids
        return out, n_ids

    def _merge_long(self, raw: np.ndarray) -> np.ndarray:
        parts = self.v.inner[raw]
        parts[-1] = self.v.last[raw[-1]]
        n = len(parts)
        ids, after, before = parts.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.v.ranks(parts[:-1], parts[1:]).tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        known = self.known = self.known or self.v.joins()
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.v.merged[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rank := known.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids joined by single spaces, as a vocabulary without a decoder gives them."""
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


#: Characters of text encoded at once; a longer text is a slice of its own.
SLICE_CHARS = 1 << 19


def text_slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of up to SLICE_CHARS characters; a null is empty."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > lo and size + n > SLICE_CHARS:
            yield lo, [t or "" for t in texts[lo:i]]
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, [t or "" for t in texts[lo:]]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text, as (id, ids array<int>, decoded string).

    A null text is empty: no ids and an empty decoded text. Ids may be null or repeated; every row gives one row. Other
    columns are not read. Rows never move, so a lost executor costs its own tasks only.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = Shared(docs.sparkSession, vocabulary_at(path))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, part in text_slices(texts):
                ids, offsets = encoder.encode(part)
                decoded = [encoder.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(part)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256, made where the ids are, so that no ids move.

    Nulls, empty texts and repeated rows as in `encode_documents`.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = Shared(docs.sparkSession, vocabulary_at(path))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        digits = [str(i) for i in range(len(vocabulary.value.tokens))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, part in text_slices(texts):
                ids, offsets = encoder.encode(part)
                a, b = [], []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = ids[x:y]
                    a.append(hashlib.sha256(" ".join(map(digits.__getitem__, own.tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(encoder.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(part)), pa.array(np.diff(offsets), pa.int64()),
                    pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
