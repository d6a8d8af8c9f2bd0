"""Documents as token pieces of bounded length, and the placing of pieces by a plan made from their length histogram.

A plan depends on the lengths only, of which there are at most `capacity`; it is made on the driver from one count per length.
Its runs say where the pieces of one length go, by their rank among pieces of that length, so that placing a piece needs no
look at another one. Ranks come from counts per (length, salt), never from a window over all pieces of one length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.bpe import Encoder, text_slices, vocabulary_at
from weir.llm.common import Shared, bounded_batches, saved, width


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut every `capacity` tokens.

    A null or empty text is its end token alone. `ids` are little-endian, two bytes each if the vocabulary allows it.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = Shared(docs.sparkSession, vocabulary_at(path))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        encoder = Encoder(vocabulary.value)
        narrow = "<u2" if len(vocabulary.value.tokens) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo, part in text_slices(batch.column(1).to_pylist()):
                ids, offsets = encoder.encode(part)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.append(ids[a:b], end_id)
                    for k in range(0, len(own), capacity):
                        cut = own[k:k + capacity]
                        doc.append(lo + i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.astype("<u4").tobytes()))
                        if keep_ids:
                            kept.append(cut.astype(narrow).tobytes())
                columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces of each length: at most `capacity` numbers."""
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def ranked(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `rank`: the place of each piece among those of its length, from 0, gapless."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(width(pieces.sparkSession))))
    # ranks are taken within (length, salt); a length's earlier salts are counted before
    counts = salted.groupBy("length", "_salt").count()
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")
    return (salted.withColumn("_r", F.row_number().over(own)).join(bases, ["length", "_salt"])
            .withColumn("rank", F.col("_base") + F.col("_r") - 1).drop("_salt", "_r", "_base"))


class CapacityTree:
    """Open bins by remaining capacity: a segment tree that finds the least capacity that still takes a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, gap: int, by: int) -> None:
        i = self.leaves + gap
        while i:
            self.some[i] += by
            i >>= 1

    def add(self, gap: int, first_bin: int, bins: int, offset: int) -> None:
        if gap and bins:
            self.runs[gap].append((first_bin, bins, offset))
            self._mark(gap, 1)

    def take(self, gap: int) -> tuple[int, int, int]:
        self._mark(gap, -1)
        return self.runs[gap].pop()

    def fit(self, length: int) -> int:
        """The least capacity of an open bin that is at least `length`, or 0."""
        i = self.leaves + length
        while not self.some[i]:
            while i & 1:
                i >>= 1
            if not i:
                return 0
            i += 1  # the neighbour on the right, whose capacities are larger
        while i < self.leaves:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.leaves


class Plan:
    """Runs (length, first rank, first bin, copies in a bin, offset, pieces)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.next_rank, self.capacity = dict(counts), dict.fromkeys(counts, 0), capacity
        self.bins, self.runs, self.open = 0, [], CapacityTree(capacity)

    def put(self, length: int, first_bin: int, bins: int, copies: int, offset: int) -> None:
        n = bins * copies
        self.runs.append((length, self.next_rank[length], first_bin, copies, offset, n))
        self.next_rank[length] += n
        self.left[length] -= n

    def new_bins(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def best_fit(self, length: int) -> None:
        """All pieces of a length into the fullest bins that take them, then into new ones."""
        while self.left[length]:
            gap = self.open.fit(length)
            first, bins, offset = self.open.take(gap) if gap else (self.bins, self.left[length], 0)
            gap = gap or self.capacity
            copies = min(gap // length, self.left[length])
            used = min(bins, self.left[length] // copies)
            if first == self.bins:
                self.new_bins(used)
            else:
                self.open.add(gap, first + used, bins - used, offset)
            self.put(length, first, used, copies, offset)
            self.open.add(gap - copies * length, first, used, offset + copies * length)

    def place(self, pieces: DataFrame) -> DataFrame:
        """Adds `sequence_id` and `offset` to ranked pieces."""
        runs = sorted(self.runs)
        table = np.array(runs, np.int64).reshape(len(runs), 6)
        keys = (table[:, 0] << 40) + table[:, 1]
        shared = pieces.sparkSession.sparkContext.broadcast((keys, table))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "rank")

        def run(batches):
            keys, table = shared.value
            for batch in batches:
                names = batch.schema.names
                length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                _, start, first, copies, offset, _ = table[np.searchsorted(keys, (length << 40) + rank, "right") - 1].T
                kept = [c for c in names if c != "rank"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(names.index(c)) for c in kept), pa.array(first + (rank - start) // copies),
                     pa.array(offset + (rank - start) % copies * length)], names=[*kept, "sequence_id", "offset"])

        return pieces.mapInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int, end_id: int, plan, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places; `plan` makes a Plan from a length histogram."""
    pieces = saved(token_pieces(docs, path, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    return plan(histogram(pieces), capacity).place(ranked(pieces, id_col))


def partner(lengths: list[int], left: dict[int, int], most: int) -> int:
    """The largest of the ascending lengths up to `most` of which pieces are left, or 0."""
    i = bisect_right(lengths, most)
    while i and not left[lengths[i - 1]]:
        i -= 1
    return lengths[i - 1] if i else 0
