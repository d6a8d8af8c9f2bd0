"""Packed token matrices as files: best-fit-decreasing packing with a capacity search in a segment tree.

Documents are packed in blocks of `BLOCK_TOKENS` as their tasks read them, so that token ids never move between tasks and a
task holds one block. A block of 2048 full rows leaves at most a few rows short.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.bpe import Encoder, text_slices, vocabulary_at
from weir.llm.common import Shared, bounded_batches
from weir.llm.pieces import Plan

BLOCK_TOKENS = 1 << 23


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """All lengths, longest first, each into the bin of least remaining capacity that takes it."""
    plan = Plan(counts, capacity)
    for length in sorted(counts, reverse=True):
        plan.best_fit(length)
    return plan


def packed_rows(block: list[tuple], capacity: int, pad_id: int, size: int) -> list[dict]:
    """The rows of a block of pieces (id, piece, start, ids)."""
    by_length = defaultdict(list)
    for x in block:
        by_length[len(x[3])].append(x)
    plan = best_fit_decreasing({n: len(own) for n, own in by_length.items()}, capacity)
    bins = [[] for _ in range(plan.bins)]
    for length, rank, first, copies, offset, n in plan.runs:
        for i, x in enumerate(by_length[length][rank:rank + n]):
            bins[first + i // copies].append((offset + i % copies * length, x))
    rows = []
    for own in bins:
        own.sort(key=lambda x: x[0])
        own = [x for _, x in own]
        ends = np.cumsum([len(x[3]) for x in own]).tolist()
        ids, places = np.full(capacity, pad_id, f"<u{size}"), np.zeros(capacity, f"<u{2 if capacity <= 1 << 16 else 4}")
        for a, b, x in zip([0, *ends], ends, own):
            ids[a:b], places[a:b] = x[3], np.arange(b - a)
        rows.append({"n_tokens": ends[-1], "id_bytes": size, "ids": ids.tobytes(), "cu_seqlens": [0, *ends],
                     "positions": places.tobytes(), "doc_ids": [x[0] for x in own], "pieces": [x[1] for x in own],
                     "starts": [x[2] for x in own]})
    return rows


def write_packed(docs: DataFrame, path: str, vocabulary: str, capacity: int = 4096, end_id: int = 1, pad_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the packed rows of all documents as Parquet under `path` and returns them.

    A row is a sequence: `sequence_id`, `n_tokens`, `ids` (binary, `capacity` little-endian ids of `id_bytes` bytes, padded
    with `pad_id`), `cu_seqlens` (cumulative segment lengths from 0 to n_tokens), `positions` (binary, two bytes each up to a
    capacity of 65536: places that start again from 0 at each segment, 0 in the padding), and for each segment the document's
    id, the piece and the start in the document, so that overlong documents can be put together again. A null or empty text
    is one end token; repeated rows are packed each; null ids are kept; an empty table gives no rows; other columns are not
    read.
    """
    bounded_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, vocabulary_at(vocabulary))
    kind = docs.select(id_col).schema[0].dataType
    fields = [("sequence_id", "long"), ("n_tokens", "int"), ("id_bytes", "int"), ("ids", "binary"), ("cu_seqlens", "array<int>"),
              ("positions", "binary"), ("doc_ids", f"array<{kind.simpleString()}>"), ("pieces", "array<int>"), ("starts", "array<long>")]
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}

    def run(batches):
        encoder, size = Encoder(shared.value), 2 if len(shared.value.tokens) <= 1 << 16 else 4
        block, tokens, next_id, id_type = [], 0, TaskContext.get().partitionId() << 33, None

        def out():
            nonlocal next_id
            rows = packed_rows(block, capacity, pad_id, size)
            for a in range(0, len(rows), 256):
                part = rows[a:a + 256]
                columns = [pa.array(range(next_id, next_id + len(part)), pa.int64())]
                next_id += len(part)
                columns += [pa.array([r[n] for r in part], pa.list_(id_type) if n == "doc_ids" else arrow[t]) for n, t in fields[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

        for batch in batches:
            id_type = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for lo, part in text_slices(batch.column(1).to_pylist()):
                ids, offsets = encoder.encode(part)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.append(ids[a:b], end_id).astype(f"<u{size}")
                    for k in range(0, len(own), capacity):
                        block.append((doc_ids[lo + i], k // capacity, k, own[k:k + capacity]))
                    tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield from out()
                    block, tokens = [], 0
        if block:
            yield from out()

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(T.StructType(rows.schema.fields)).parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """The written rows with crc32 sums in place of the matrices."""
    schema = ("sequence_id long, n_tokens int, n_segments int, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, "
              "ids_crc32 long, positions_crc32 long")

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ids = [x.as_py() for x in cols["ids"]]
            yield pa.RecordBatch.from_arrays([
                cols["sequence_id"], cols["n_tokens"], pa.array([len(x) - 1 for x in cols["cu_seqlens"]], pa.int32()),
                cols["cu_seqlens"], cols["doc_ids"], cols["pieces"], pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.as_py()) for x in cols["positions"]], pa.int64())],
                names=["sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "pieces", "ids_crc32", "positions_crc32"])

    return rows.select("sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "ids", "positions").mapInArrow(run, schema)
