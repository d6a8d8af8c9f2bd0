"""Hierarchical packing of documents into windows of several lengths.

Documents are packed in blocks of `BLOCK_TOKENS` as their tasks read them, so that no ids move between tasks and a task holds
one block. Whole windows of the longest tier are cut off first; what is left of a document goes to the shortest tier that holds
it. Every tier is packed from the longest to the shortest: a window takes one of its own documents, then the longest documents
of shorter tiers that fit its gap, and at last the head of the shortest document that does not. Only the last window of a block
can be left short; it is cut into windows of powers of two. Windows are then dealt to step groups of equal tokens and cost.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.bpe import byte_symbols, text_slices
from weir.llm.common import bounded_batches

BLOCK_TOKENS = 1 << 22
TIERS = (1024, 512, 256, 128)
#: Fixed value: the pattern at which byte-level vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_vocabulary(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """(rank of each token's bytes in base64, special tokens) of a byte-level vocabulary whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        raise ValueError(f"ids of {path} do not follow its merges")
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    return {base64.b64encode(bytes(byte_of[c] for c in token)).decode(): i
            for token, i in model["vocab"].items() if token not in special}, special


def byte_encoding(ranks: dict[str, int], special: dict[str, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, special_tokens=special,
                             mergeable_ranks={base64.b64decode(token): i for token, i in ranks.items()})


class Shelf:
    """Parts of documents by length; the bits of `mask` are the lengths there are."""

    def __init__(self, longest: int):
        self.parts: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def add(self, length: int, part: tuple[int, int]) -> None:
        self.parts[length].append(part)
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        part = self.parts[length].pop()
        if not self.parts[length]:
            self.mask ^= 1 << length
        return part

    def longest(self, limit: int) -> int:
        """The longest length up to `limit`, or 0."""
        return max(0, (self.mask & ((2 << limit) - 1)).bit_length() - 1)

    def shortest(self, above: int) -> int:
        """The shortest length over `above`, or 0."""
        rest = self.mask >> (above + 1)
        return (rest & -rest).bit_length() + above if rest else 0


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, [(document, start, length), ...]) that hold every token of documents of these lengths once.

    Sizes are tiers, but for at most one window of each smaller power of two at the end; every window is full.
    """
    windows, shelf = [], Shelf(tiers[0])
    for doc, n in enumerate(lengths):
        whole = n - n % tiers[0]
        windows += [(tiers[0], [(doc, at, tiers[0])]) for at in range(0, whole, tiers[0])]
        if n > whole:
            shelf.add(n - whole, (doc, whole))
    rest = []
    for tier, shorter in zip(tiers, (*tiers[1:], 0)):
        while (n := shelf.longest(tier)) > shorter:
            window, gap = [(*shelf.take(n), n)], tier - n
            while gap:
                if n := shelf.longest(min(gap, shorter or gap)) or shelf.longest(gap):
                    window.append((*shelf.take(n), n))
                    gap -= n
                elif n := shelf.shortest(gap):  # nothing fits whole: its head closes the gap, its tail goes to a shorter tier
                    doc, at = shelf.take(n)
                    window.append((doc, at, gap))
                    shelf.add(n - gap, (doc, at + gap))
                    gap = 0
                else:
                    break
            if gap:
                rest = window
            else:
                windows.append((tier, window))
    size = 1 << sum(n for _, _, n in rest).bit_length()
    while rest:
        size >>= 1
        if sum(n for _, _, n in rest) < size:
            continue
        window, gap = [], size
        while gap:
            doc, at, n = rest.pop()
            window.append((doc, at, min(n, gap)))
            if n > gap:
                rest.append((doc, at + gap, n - gap))
            gap -= min(n, gap)
        windows.append((size, window))
    return windows


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A group for each window. Groups differ by at most one longest window in tokens; windows of one size are dealt by
    falling cost (the sum of squared lengths, as attention within documents has it), each to the group that has least."""
    count = max(1, round(sum(size for size, _ in windows) / step_tokens))
    cost = [sum(n * n for _, _, n in window) for _, window in windows]
    heap, group = [(0, 0, g) for g in range(count)], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-windows[i][0], -cost[i])):
        tokens, spent, g = heap[0]
        group[i] = g
        heapq.heapreplace(heap, (tokens + windows[i][0], spent + cost[i], g))
    return group


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = 1 << 16,
                   block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in full windows of the tiers' lengths: one row per piece of a document.

    Returns (id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group): `ids` are the piece's ids, four
    little-endian bytes each; `tier` is the window's length, `step_group` the training step its block deals it to. Tiers are
    falling powers of two. A null or empty text is its end token alone; repeated rows are packed each; null ids are kept; an
    empty table gives no rows; a very long text fills whole windows first; other columns are not read, whatever their names.
    Numbers of sequences and groups are unique over the table and follow from the input's splits alone, so that a task that
    is run again after a lost executor gives the same rows.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError(f"tiers are falling powers of two: {tiers}")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(byte_vocabulary(vocabulary))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def placed(block: list[np.ndarray], doc_ids: pa.Array, first: int, first_group: int) -> Iterator[pa.RecordBatch]:
        windows = pack_block([len(x) for x in block], tiers)
        groups = step_groups(windows, step_tokens)
        for a in range(0, len(windows), 1024):
            rows = [(doc, at, n, block[doc][at:at + n].astype("<u4").tobytes(), len(block[doc]), first + i, offset, size, first_group + g)
                    for i, ((size, window), g) in enumerate(zip(windows[a:a + 1024], groups[a:a + 1024]), a)
                    for (doc, at, n), offset in zip(window, np.cumsum([0, *(n for _, _, n in window)]).tolist())]
            doc, start, length, ids, total, sequence, offset, tier, group = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()),
                 pa.array(group, pa.int64())], names=names)

    def run(batches):
        encoding = byte_encoding(*shared.value)
        block, block_ids, tokens, made = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, part in text_slices(batch.column(1).to_pylist()):
                for text in part:
                    block.append(np.array([*encoding.encode(text, allowed_special="all"), end_id], np.uint32))
                    tokens += len(block[-1])
                block_ids.append(batch.column(0).slice(lo, len(part)))
                if tokens >= block_tokens:
                    yield from placed(block, pa.concat_arrays(block_ids), made, made)
                    made += tokens  # there are no more windows or groups than tokens
                    block, block_ids, tokens = [], [], 0
        if block:
            yield from placed(block, pa.concat_arrays(block_ids), made, made)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    ).withColumnRenamed("id", id_col)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
