"""Passages that repeat across documents, exactly or nearly, by collinear chaining of shared k-mer seeds.

Seeds are all k-word hashes. A seed of up to `FEW` places is matched at all pairs of them. A commoner seed is matched with its
home alone, its first place in the document of smallest id, so that it gives as many matches as places; where such seeds follow
one another, runs of 2k, 4k, ... and `min_words` words are looked up in the same way, so that a whole passage finds a document
that has it whole, wherever its seeds are at home. Seeds are sorted with numpy in buckets of hashes. The matches of two documents are
chained in the order of both texts: a chain's score is the words it covers less `GAP` for each word between its parts, found
with Fenwick trees of the runs within `REACH`. Chains are aligned word by word on the whole texts' words, divided where the texts
differ, their ends stretched as far as the texts agree, and a document's aligned stretches are joined where they touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.arrays import LOWER, SpanHasher, mix, shingles, slices, words
from weir.llm.common import bounded_batches, free_name, saved, small

#: Of a seed that follows upon itself, one place in so many words counts.
STRIDE = 8
#: A seed of up to FEW places is matched at all pairs of them, a commoner one with its home.
FEW = 8
#: Letters of text for each bucket in which seeds are sorted.
BUCKET_LETTERS = 6_000_000
#: Cost of a word between two matches, in words; matches further apart than REACH words are no chain.
GAP, REACH = 0.25, 64
#: A gap that costs more than FAR words that differ divides a chain; its equal words count against them.
FAR = 8
#: Equal words in a row that make a run of an alignment; fewer belong to the gap around them.
EQUAL = 3
#: Words beyond the outermost matches that may belong to a passage: as far as matches of a chain may be apart.
STRETCH = REACH
#: Words of the blocks in which word windows are fetched.
BLOCK = 64
#: Chains handled at once.
CHAINS = 8192


def told_apart(seed: np.ndarray, of: np.ndarray):
    """(places to keep, their seeds). Where words go round in circles, one seed follows upon itself; of such a row one place in
    STRIDE words stays, with its number in the row mixed into the seed. The seeds of a text stand at its places one by one."""
    close = np.zeros(len(seed), bool)
    for d in range(1, 2 * STRIDE + 1):
        again = (seed[d:] == seed[:-d]) & (of[d:] == of[:-d])
        close[d:] |= again
        close[:len(again)] |= again
    at = np.flatnonzero(close)
    at = at[np.lexsort((at, seed[at], of[at]))]
    row = np.zeros(len(at), bool)
    row[1:] = (seed[at[1:]] == seed[at[:-1]]) & (of[at[1:]] == of[at[:-1]]) & (at[1:] - at[:-1] <= 2 * STRIDE)
    start = np.maximum.accumulate(np.where(row, 0, np.arange(len(at)))) if len(at) else at
    number = (at - at[start]) // STRIDE
    gone = row & (number == np.concatenate(([0], number[:-1]))[:len(at)])
    seed, keep = seed.copy(), np.ones(len(seed), bool)
    seed[at] = np.where(number > 0, mix(seed[at] + number.astype(np.uint64)), seed[at])
    keep[at[gone]] = False
    keep = np.flatnonzero(keep)
    return keep, seed[keep]


def text_words(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher):
    data = LOWER[data]
    starts, ends, per_text = words(data, offsets)
    return hasher(data, starts, ends), per_text


PLACE = np.dtype([("seed", np.uint64), ("doc", np.int64), ("pos", np.int32), ("size", np.int32)])
PACKED = "bucket int, places binary"


def squeezed(data: bytes) -> bytes:
    """Bytes as they are shuffled and saved: zstd, after their number."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Differences of neighbours, first their lowest bytes and so on: mostly zeros, which compression takes out."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return step.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, kind: type, n: int, start: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    step = np.frombuffer(data, np.uint8, n * size, start).reshape(size, n).T
    return np.cumsum(np.ascontiguousarray(step).view(kind)[:, 0], dtype=kind)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def packed(seed, doc, pos, size, buckets: int):
    """Places of seeds as one row for each bucket of seeds: all seeds in the order given, then documents, places and sizes."""
    bucket = bucket_of(seed, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, seed, doc, pos, size = (c[order] for c in (bucket, seed, doc.astype(np.int64), pos.astype(np.int32), size.astype(np.int32)))
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(seed) else np.zeros(0, int)
    ends = np.append(cut[1:], len(seed))
    rows = [squeezed(b"".join((seed[a:b].tobytes(), planes(doc[a:b]), planes(pos[a:b]), planes(size[a:b]))))
            for a, b in zip(cut.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "places"])


def unpacked(data: bytes) -> np.ndarray:
    data = whole(data)
    n = len(data) // PLACE.itemsize
    out = np.empty(n, PLACE)
    out["seed"] = np.frombuffer(data, np.uint64, n)
    out["doc"], out["pos"], out["size"] = (from_planes(data, kind, n, at * n) for kind, at in ((np.int64, 8), (np.int32, 16), (np.int32, 20)))
    return out


def seeds(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """All k-word hashes of the texts, packed. Texts under k words give none."""
    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(1)):
                w, per_text = text_words(data, offsets, hasher)
                h, at = shingles(w, per_text, k)
                of = np.repeat(np.arange(len(at) - 1), np.diff(at))
                kept, seed = told_apart(h, of)
                real = np.diff(per_text)[of[kept]] >= k
                kept, seed = kept[real], seed[real]
                of = of[kept]
                yield packed(mix(seed), ids[lo + of], (kept - at[of]).astype(np.int32), np.full(len(seed), k, np.int32), buckets)

    return docs.mapInArrow(run, PACKED)


#: Rows of a part of the documents: the places of seeds that several documents hold, by the seed's number in its bucket, and matches.
FOUND = "part int, bucket int, places binary, found binary"
HELD = [("doc", np.int64), ("pos", np.int32), ("number", np.int32), ("common", np.int32)]
MATCH = [("doc", np.int64), ("ref", np.int64), ("pos", np.int32), ("ref_pos", np.int32), ("size", np.int32)]


def dealt(columns: dict[str, np.ndarray], kind: list, parts: int) -> dict[int, bytes]:
    """Columns packed as bytes for each part of the documents, in the order of documents, then of references or places."""
    names = [name for name, _ in kind]
    part = bucket_of(mix(columns["doc"].view(np.uint64)), parts)
    order = np.lexsort((columns["pos"], columns[names[1]], columns["doc"], part))
    part, cols = part[order], [columns[name][order].astype(t) for name, t in kind]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, int)
    return {int(part[a]): squeezed(b"".join(planes(c[a:b]) for c in cols)) for a, b in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist())}


def undealt(data: list[bytes], kind: list) -> list[np.ndarray]:
    """The columns that `dealt` packed, of several rows one after the other."""
    size, out = sum(np.dtype(t).itemsize for _, t in kind), []
    for row in data:
        row, at, cols = whole(row), 0, []
        n = len(row) // size
        for _, t in kind:
            cols.append(from_planes(row, t, n, at))
            at += n * np.dtype(t).itemsize
        out.append(cols)
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for _, t in kind]


def by_key(batches):
    """(key, rows) of rows of Arrow batches that follow one another with the same first column."""
    now, held = None, []
    for batch in batches:
        for key, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append([c.as_py() for c in row])
    if held:
        yield now, held


def matches(places: DataFrame, few: int, with_places: bool, parts: int) -> DataFrame:
    """Matches of places with places in documents of smaller id, dealt by parts of the documents, and with `with_places` the
    places whose seed several documents hold.

    A place is matched with all earlier ones if its seed has up to `few` places, else with the seed's home alone.
    """
    def of_bucket(bucket, rows):
        x = np.concatenate([unpacked(p) for p, in rows])
        order = np.argsort(x["seed"])
        seed = x["seed"][order]
        again = np.concatenate(([False], seed[1:] == seed[:-1], [False]))
        x = x[order[again[1:] | again[:-1]]]  # seeds of one place match nothing
        x = x[np.lexsort((x["pos"], x["doc"], x["seed"]))]
        new = np.ones(len(x), bool)
        new[1:] = x["seed"][1:] != x["seed"][:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(x)))
        several = x["doc"][first] < x["doc"][first + count - 1]
        x, count = x[np.repeat(several, count)], count[several]
        number = np.repeat(np.arange(len(count)), count)
        first = np.repeat(np.cumsum(count) - count, count)
        common = np.repeat(count > few, count)
        held = dealt({"doc": x["doc"], "pos": x["pos"], "number": number, "common": common}, HELD, parts) if with_places else {}
        far = np.flatnonzero(common & (x["doc"] > x["doc"][first])) if len(x) else first
        later, earlier = [far], [first[far]]
        for d in range(1, few):
            at = np.arange(d, len(x))
            at = at[~common[d:] & (at - d >= first[d:]) & (x["doc"][d:] > x["doc"][:-d])]
            later.append(at)
            earlier.append(at - d)
        later, earlier = np.concatenate(later), np.concatenate(earlier)
        found = dealt({"doc": x["doc"][later], "ref": x["doc"][earlier], "pos": x["pos"][later], "ref_pos": x["pos"][earlier],
                       "size": x["size"][later]}, MATCH, parts)
        part = sorted({*held, *found})
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([bucket] * len(part), pa.int32()),
                                           *(pa.array([c.get(p) for p in part], pa.binary()) for c in (held, found))],
                                          names=["part", "bucket", "places", "found"])

    def run(batches):
        for bucket, rows in by_key(batches):
            yield of_bucket(bucket, rows)

    return places.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def longer(found: DataFrame, k: int, sizes: list[int], buckets: int) -> DataFrame:
    """Runs of `sizes` words, all of whose seeds several documents hold and some of them often, as packed places."""
    rows = found.filter("places is not null").select("part", "bucket", "places").repartition("part").sortWithinPartitions("part")

    def keys(doc, pos, seed, common):
        place = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))) if len(doc) else np.zeros(0, int)
        doc, pos, seed, common = doc[place], pos[place], seed[place], common[place]
        of = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) if len(doc) else doc
        line = of.astype(np.int64) << 33 | pos.astype(np.int64)
        out = []
        for size in sizes:
            at = np.arange(len(line))
            key, often = np.full(len(at), size, np.uint64), np.zeros(len(at), bool)
            for step in [*range(0, size - k, k), size - k]:
                there = np.minimum(np.searchsorted(line, line[at] + step), max(len(line) - 1, 0))
                same = line[there] == line[at] + step
                at, key, often, there = at[same], key[same], often[same], there[same]
                key, often = mix(key * np.uint64(0x9FB21C651E98DF25) + seed[there]), often | common[there]
            at, key = at[often], key[often]
            out.append((key, doc[at], pos[at], np.full(len(at), size, np.int32)))
        return packed(*(np.concatenate(c) for c in zip(*out)), buckets)

    def run(batches):
        for _, rows in by_key(batches):
            cols = [[*undealt([places], HELD), bucket] for bucket, places in rows]
            doc, pos, common = (np.concatenate([c[i] for c in cols]) for i in (0, 1, 3))
            seed = np.concatenate([c[2].astype(np.uint64) | np.uint64(c[4]) << np.uint64(32) for c in cols])
            order = np.lexsort((seed, pos, doc))
            yield keys(doc[order], pos[order], mix(seed[order]), common[order] > 0)

    return rows.mapInArrow(run, PACKED)


def matched(docs: DataFrame, k: int, min_words: int) -> DataFrame:
    """(part, found) of matches of single seeds and, where those are common, of runs of up to `min_words` words."""
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(1 + letters // BUCKET_LETTERS, 1 << 30)
    found = saved(matches(seeds(docs, k, buckets), FEW, True, buckets), "seeds", clean=True)
    sizes, size = [], 2 * k
    while size < min_words:
        sizes, size = [*sizes, size], 2 * size
    own = found.filter("found is not null").select("part", "found")
    if min_words <= k:
        return own
    runs_ = saved(matches(longer(found, k, [*sizes, min_words], buckets), FEW, False, buckets).select("part", "found"), "runs", clean=True)
    return own.unionByName(runs_)


# ---- chaining --------------------------------------------------------------------------------------

def runs(pair: np.ndarray, q: np.ndarray, r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of pairs of documents joined along their diagonals: (pair, rows of q from, q to, r from, r to), in order."""
    order = np.lexsort((q, q - r, pair))
    pair, q, r, end = pair[order], q[order], r[order], (q + size)[order]
    new = np.ones(len(q), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (q[1:] - r[1:] != q[:-1] - r[:-1])
    line = np.cumsum(new)
    far = np.maximum.accumulate(end + line * (1 << 33)) - line * (1 << 33)  # furthest end so far on the diagonal
    new[1:] |= q[1:] - far[:-1] > 2 * STRIDE
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(q)) - 1
    pair, parts = pair[cut], np.stack((q[cut], far[last], r[cut], r[cut] + far[last] - q[cut]), 1)
    order = np.lexsort((parts[:, 2], parts[:, 0], pair))
    return pair[order], parts[order]


#: Places of a cell: a predecessor within REACH lies in the cell of the place itself or in the one before.
CELL = REACH + 1
NONE = (-1e18, -1)


class Fenwick:
    """Prefix maxima of (value, item) over the places of a cell; nothing leaves it."""

    def __init__(self):
        self.best = [NONE] * (CELL + 1)

    def put(self, i: int, entry: tuple[float, int]) -> None:
        i += 1
        while i <= CELL:
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        found, i = NONE, i + 1
        while i:
            found = max(found, self.best[i])
            i &= i - 1
        return found


class Cells:
    """Runs by the end of their reference: for each cell of places a Fenwick tree from its start and one from its end."""

    def __init__(self):
        self.trees: dict[int, tuple[Fenwick, Fenwick]] = {}

    def put(self, place: int, entry: tuple[float, int]) -> None:
        cell, i = divmod(place, CELL)
        if cell not in self.trees:
            self.trees[cell] = Fenwick(), Fenwick()
        ahead, back = self.trees[cell]
        ahead.put(i, entry)
        back.put(CELL - 1 - i, entry)

    def within(self, place: int) -> tuple[float, int]:
        """The best of the runs that end at most REACH places before."""
        cell, i = divmod(place, CELL)
        found = self.trees[cell][0].upto(i) if cell in self.trees else NONE
        return max(found, self.trees[cell - 1][1].upto(CELL - 2 - i)) if cell - 1 in self.trees else found


def chains(parts: np.ndarray) -> list[list[int]]:
    """Best-scoring chains of the runs of two documents, each run in at most one; parts are in order of their q start.

    The runs that start in one cell of the document are taken together. Those that ended in the cell before all have their scores by
    then, so they are put in from the last one back, as far as each start reaches; those that end in the cell itself
    are put in as they end. So trees only grow, and hold just what is within reach.
    """
    n = len(parts)
    if n == 1:
        return [[0]]
    q0, q1, r0, r1 = parts.T.tolist()
    score, before, ended, starting = [0.0] * n, [-1] * n, {}, {}
    for i in sorted(range(n), key=q1.__getitem__):
        ended.setdefault(q1[i] // CELL, []).append(i)
    for i in range(n):
        starting.setdefault(q0[i] // CELL, []).append(i)
    entry = lambda j: (score[j] + GAP * (q1[j] + r1[j]), j)
    for cell, own in starting.items():
        old, left, found = Cells(), list(ended.get(cell - 1, [])), {}
        for i in reversed(own) if left else []:
            while left and q1[left[-1]] >= q0[i] - REACH:
                j = left.pop()
                old.put(r1[j], entry(j))
            found[i] = old.within(r0[i])
        now, coming, w = Cells(), ended.get(cell, []), 0
        for i in own:
            while w < len(coming) and q1[coming[w]] <= q0[i]:  # finished runs can be continued
                now.put(r1[coming[w]], entry(coming[w]))
                w += 1
            value, j = max(now.within(r0[i]), found.get(i, NONE))
            gain = value - GAP * (q0[i] + r0[i])
            score[i] = q1[i] - q0[i]
            if j >= 0 and gain > 0:
                score[i] += gain
                before[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def chained(found: DataFrame) -> DataFrame:
    """(doc, ref, q0, q1, r0, r1, parts) of chains."""
    rows = found.repartition("part").sortWithinPartitions("part")
    schema = "doc long, ref long, q0 int, q1 int, r0 int, r1 int, parts array<int>"

    def run(batches):
        for _, rows in by_key(batches):
            doc, ref, q, r, size = undealt([row for row, in rows], MATCH)
            order = np.lexsort((ref, doc))
            doc, ref = doc[order], ref[order]
            pair = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]))))
            pairs, parts = runs(pair, *(c[order].astype(np.int64) for c in (q, r, size)))
            first = np.searchsorted(pair, pairs)  # a match of the pair
            cut = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            count = np.diff(np.append(cut, len(pairs)))
            own, items = [cut[count == 1]], []  # most pairs have one run, which is a chain
            for a, n in zip(cut[count > 1].tolist(), count[count > 1].tolist()):
                items += [[a + i for i in chain] for chain in chains(parts[a:a + n])]
            own = np.concatenate((*own, *items)).astype(np.int64)
            length = np.concatenate((np.ones(int((count == 1).sum()), np.int64), np.array([len(c) for c in items], np.int64)))
            end = np.cumsum(length)
            start = end - length
            for a in range(0, len(length), CHAINS):
                b = min(a + CHAINS, len(length))
                lo, hi, some = own[start[a:b]], own[end[a:b] - 1], own[start[a]:end[b - 1]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(start[a:b], end[b - 1]) * 4 - start[a] * 4, pa.int32()),
                                                 pa.array(parts[some].ravel().astype(np.int32)))
                ends = (parts[lo, 0], parts[hi, 1], parts[lo, 2], parts[hi, 3])
                yield pa.RecordBatch.from_arrays([pa.array(doc[first[lo]]), pa.array(ref[first[lo]]), *(pa.array(c.astype(np.int32)) for c in ends), lists],
                                                 names=["doc", "ref", "q0", "q1", "r0", "r1", "parts"])

    return rows.mapInArrow(run, schema)


# ---- chains that can make a passage ----------------------------------------------------------------

def prints(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Four bits of each of the STRETCH words before and after the places (id, lo, hi) that are asked for, from the place on, and how
    many words come after: adds `print`, binary."""
    asked = asked.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))
    rows = docs.select(F.col("doc").alias("id"), "text").join(asked, "id")
    size = STRETCH + 1

    def run(batches):
        hasher, step = SpanHasher(), np.arange(STRETCH)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(1)):
                w, per_text = text_words(data, offsets, hasher)
                bits = (np.append(w, np.uint64(0)) >> np.uint64(60)).astype(np.uint8)
                own = batch.column(2).slice(lo, hi - lo)
                at, own = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy()), own.flatten()
                x, y = own.field("lo").to_numpy(), own.field("hi").to_numpy()
                for a in range(0, len(at), CHAINS):
                    text, before, after = at[a:a + CHAINS], x[a:a + CHAINS], y[a:a + CHAINS]
                    out = np.empty((len(text), size), np.uint8)
                    for j, places in ((0, (per_text[text] + before - 1)[:, None] - step), (STRETCH // 2, (per_text[text] + after)[:, None] + step)):
                        four = bits[np.clip(places, 0, len(w))]
                        out[:, j:j + STRETCH // 2] = four[:, ::2] | four[:, 1::2] << 4
                    out[:, -1] = np.clip(per_text[text + 1] - per_text[text] - after, 0, STRETCH)
                    binary = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(np.arange(len(out) + 1, dtype=np.int32) * size), pa.py_buffer(out)])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + text]), pa.array(before), pa.array(after), binary], names=["id", "lo", "hi", "print"])

    return rows.select("id", "text", "asked").mapInArrow(run, "id long, lo int, hi int, print binary")


def longest_stretch(q: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row, no fewer words than `stretch` takes of the `n` words whose bits are given, as bits of equal words are equal."""
    four = lambda x: np.stack((x & 15, x >> 4), 2).reshape(len(x), -1)
    there = np.arange(STRETCH) < n[:, None]
    score = np.cumsum(np.where(there, np.where(four(q) == four(r), 1, -1), -2 * STRETCH), 1)
    best = STRETCH - 1 - score[:, ::-1].argmax(1)
    return np.where(score[np.arange(len(best)), best] > 0, best + 1, 0)


def in_passages(spans: DataFrame, min_words: int) -> DataFrame:
    """Spans (doc, lo, hi, ref, ref_lo) that touch or overlap as passages [passage_start, passage_end); passages of fewer than
    `min_words` words or without a span of half as many go."""
    order = Window.partitionBy("doc").orderBy("lo", "hi", "ref", "ref_lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", (F.col("lo") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole_ = Window.partitionBy("doc", "_island")
    return islands.withColumns({"passage_start": F.min("lo").over(whole_), "passage_end": F.max("hi").over(whole_),
                                "_longest": F.max(F.col("hi") - F.col("lo")).over(whole_)}).filter(
        (F.col("passage_end") - F.col("passage_start") >= min_words) & (F.col("_longest") >= min_words // 2))


def promising(docs: DataFrame, chains_: DataFrame, min_words: int) -> DataFrame:
    """The chains that can have a part in a passage. A chain begins and ends with equal words, so its stretches lie between its ends and
    as far beyond as the words next to it can agree, which four bits of each word bound from above. Passages that these bounds make
    hold all that the stretches make; the chains of those too short are left out, most of all chains."""
    chains_ = saved(chains_, "chains", clean=True)
    own = prints(docs, chains_.select(F.col("doc").alias("id"), F.col("q0").alias("lo"), F.col("q1").alias("hi")).distinct())
    other = prints(docs, chains_.select(F.col("ref").alias("id"), F.col("r0").alias("lo"), F.col("r1").alias("hi")).distinct())
    own = own.select(F.col("id").alias("doc"), F.col("lo").alias("q0"), F.col("hi").alias("q1"), F.col("print").alias("q"))
    other = other.select(F.col("id").alias("ref"), F.col("lo").alias("r0"), F.col("hi").alias("r1"), F.col("print").alias("r"))
    cols = [*chains_.columns]
    rows = chains_.join(own, ["doc", "q0", "q1"]).join(other, ["ref", "r0", "r1"]).select(*cols, "q", "r")

    def run(batches):
        for batch in batches:
            q, r = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, STRETCH + 1) for c in (len(cols), len(cols) + 1))
            q0, q1, r0 = (batch.column(cols.index(c)).to_numpy().astype(np.int64) for c in ("q0", "q1", "r0"))
            half = STRETCH // 2
            back = longest_stretch(q[:, :half], r[:, :half], np.minimum(np.minimum(q0, r0), STRETCH))
            ahead = longest_stretch(q[:, half:-1], r[:, half:-1], np.minimum(q[:, -1], r[:, -1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], pa.array((q0 - back).astype(np.int32)), pa.array((q1 + ahead).astype(np.int32))],
                                             names=[*cols, "lo", "hi"])

    bounds = rows.mapInArrow(run, T.StructType([*chains_.schema.fields, T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
    return in_passages(bounds.withColumn("ref_lo", F.col("r0")), min_words).select(*cols)


# ---- aligning --------------------------------------------------------------------------------------

def word_windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The words, as hashes, of the windows (id, lo, hi) that are asked for: adds `words`, binary of uint32."""
    asked = asked.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))  # a text is read once for all its windows
    rows = docs.select(F.col("doc").alias("id"), "text").join(asked, "id")

    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            asked = batch.column(2)
            for lo, hi, data, offsets in slices(batch.column(1)):
                w, per_text = text_words(data, offsets, hasher)
                w = (w >> np.uint64(32)).astype(np.uint32)
                for i in range(lo, hi):
                    own = asked[i].values
                    x, y = own.field("lo"), own.field("hi")
                    a, b = per_text[i - lo], per_text[i - lo + 1]
                    out = [w[min(a + c, b):min(a + d, b)].tobytes() for c, d in zip(x.to_pylist(), y.to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()), x, y, pa.array(out, pa.binary())],
                                                     names=["id", "lo", "hi", "words"])

    return rows.select("id", "text", "asked").mapInArrow(run, "id long, lo int, hi int, words binary")


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in a best alignment of two short runs."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal words) of the best common start, a differing word costing one; the longest of equals."""
    n = min(len(a), len(b), STRETCH)
    same = a[:n] == b[:n]
    if not n or not same.any():
        return 0, 0
    score = np.cumsum(np.where(same, 1, -1))
    best = n - 1 - int(score[::-1].argmax())
    return (best + 1, int(same[:best + 1].sum())) if score[best] > 0 else (0, 0)


def high_scoring(scores: list[int]) -> list[tuple[int, int]]:
    """The maximal-scoring runs [from, to) of neighbours, by Ruzzo and Tompa's rule."""
    out, total = [], 0
    for i, s in enumerate(scores):
        start, low, total = i, total, total + s
        while s > 0:
            j = next((j for j in range(len(out) - 1, -1, -1) if out[j][2] < low), None)
            if j is None or out[j][3] >= total:
                out.append((start, i + 1, low, total))
                break
            start, _, low, _ = out[j]
            del out[j:]
    return [x[:2] for x in out]


def align(q: np.ndarray, r: np.ndarray, q_at: int, r_at: int, parts: np.ndarray, percent: int):
    """(q from, q to, r from, r to, equal words, aligned words) of the stretches of a chain that agree in `percent` hundredths,
    given the words from q_at and r_at on.

    An equal word and a differing one weigh as `percent` asks. A gap that costs more than FAR differing words divides the
    chain. What is left stays whole if enough of it agrees; else its stretches of highest score do.
    """
    steps = []  # equal runs with the gap before them: q from, q to, r from, r to, words, equal in the gap, gap
    for a, b, c, d in (parts - np.array([q_at, q_at, r_at, r_at])).tolist():
        if steps:
            cut = max(steps[-1][1] - a, steps[-1][3] - c, 0)  # overlapping ends belong to the earlier run
            a, c = a + cut, c + cut
        n = min(b - a, d - c)
        if n <= 0:
            continue
        same = np.concatenate(([False], q[a:a + n] == r[c:c + n], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for lo, hi in turns[turns[:, 1] - turns[:, 0] >= EQUAL].tolist():
            equal = gap = 0
            if steps:
                x, y = steps[-1][1], steps[-1][3]
                equal, gap = edits(q[x:a + lo], r[y:c + lo]), max(a + lo - x, c + lo - y)
            steps.append((a + lo, a + hi, c + lo, c + hi, hi - lo, equal, gap))
    def sums(i, j):
        gaps = steps[i + 1:j]
        equal = sum(s[4] for s in steps[i:j])
        return equal + sum(s[5] for s in gaps), equal + sum(s[6] for s in gaps)

    def stretched(i, j):
        """The runs from i up to before j with as much of their ends as leaves enough words equal; None if not enough are."""
        (equal, total), (a, _, c, *_), (_, b, _, d, *_) = sums(i, j), steps[i], steps[j - 1]
        x, y = (steps[i - 1][1], steps[i - 1][3]) if i else (0, 0)
        u, v = (steps[j][0], steps[j][2]) if j < len(steps) else (len(q), len(r))
        back, ahead = stretch(q[x:a][::-1], r[y:c][::-1]), stretch(q[b:u], r[d:v])
        found = [(m + n, q_at + a - m, q_at + b + n, r_at + c - m, r_at + d + n, equal + s + t, total + m + n)
                 for m, s in (back, (0, 0)) for n, t in (ahead, (0, 0)) if 100 * (equal + s + t) >= percent * (total + m + n)]
        return max(found)[1:] if found else None

    ends = [i for i, s in enumerate(steps) if i == 0 or 100 * s[5] - percent * s[6] < -percent * FAR] + [len(steps)]
    for i, j in zip(ends[:-1], ends[1:]):
        whole = stretched(i, j)
        if whole:
            yield whole
            continue
        scores = [x for s in steps[i:j] for x in (min(0, 100 * s[5] - percent * s[6]), (100 - percent) * s[4])][1:]
        for a, b in high_scoring(scores):
            yield stretched(i + a // 2, i + b // 2 + 1)


def aligned(docs: DataFrame, chains_: DataFrame, percent: int) -> DataFrame:
    """(doc, lo, hi, ref, ref_lo, ref_hi, equal, total) of the stretches of chains in which enough words are equal."""
    down = lambda c: (F.greatest(F.col(c) - STRETCH, F.lit(0)) / BLOCK).cast("int") * BLOCK
    up = lambda c: (((F.col(c) + STRETCH) / BLOCK).cast("int") + 1) * BLOCK
    framed = saved(chains_.withColumns({"q_lo": down("q0"), "q_hi": up("q1"), "r_lo": down("r0"), "r_hi": up("r1")}), "promising", clean=True)
    own = word_windows(docs, framed.select(F.col("doc").alias("id"), F.col("q_lo").alias("lo"), F.col("q_hi").alias("hi")).distinct())
    other = word_windows(docs, framed.select(F.col("ref").alias("id"), F.col("r_lo").alias("lo"), F.col("r_hi").alias("hi")).distinct())
    own = own.select(F.col("id").alias("doc"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("words").alias("q"))
    other = other.select(F.col("id").alias("ref"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), F.col("words").alias("r"))
    rows = framed.join(own, ["doc", "q_lo", "q_hi"]).join(other, ["ref", "r_lo", "r_hi"]).select(
        "doc", "ref", "q_lo", "r_lo", "parts", "q", "r")

    def run(batches):
        for batch in batches:
            doc, ref, q_lo, r_lo = (c.to_numpy() for c in batch.columns[:4])
            out = []
            for i in range(batch.num_rows):
                q, r = (np.frombuffer(batch.column(j)[i].as_py(), np.uint32) for j in (5, 6))
                parts = np.array(batch.column(4)[i].as_py()).reshape(-1, 4)
                for a, b, c, d, equal, total in align(q, r, int(q_lo[i]), int(r_lo[i]), parts, percent):
                    out.append((int(doc[i]), a, b, int(ref[i]), c, d, equal, total))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc", "lo", "hi", "ref", "ref_lo", "ref_hi", "equal", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, kinds)], names=names)

    return rows.mapInArrow(run, "doc long, lo int, hi int, ref long, ref_lo int, ref_hi int, equal int, total int")


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 5, percent: int = 75, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Passages of at least `min_words` words that stand, exactly or nearly, in a document of smaller id too.

    One row per aligned stretch: (id, start_word, end_word, ref_id, ref_start, ref_end, identity, passage_start,
    passage_end): words [start, end) of the document agree with words [ref_start, ref_end) of the earlier one in at least
    `percent` hundredths; stretches that touch or overlap form one passage [passage_start, passage_end), which has at least
    `min_words` words and a stretch of half as many, so that phrases of many documents side by side are none. Up to `FAR` words in
    a row that are not shared may lie within a passage. Words are lower-cased (A-Z) and end at white space. Repeats inside one document are no passages. Rows
    of one id are one document to this operator and give no passages with each other; null ids, null and empty texts give
    none; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    found = aligned(own, promising(own, chained(matched(own, k, min_words)), min_words), percent)
    return (in_passages(found, min_words)
            .select(F.col("doc").alias(id_col), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"),
                    F.col("ref").alias(f"ref_{id_col}"), F.col("ref_lo").alias("ref_start"), F.col("ref_hi").alias("ref_end"),
                    F.round(F.col("equal") / F.col("total"), 4).alias("identity"), "passage_start", "passage_end"))


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated passages cut out; all columns stay, whatever their names. A document of which no word
    is left goes. Rows of one id are cut alike; null ids and null texts stay as they are."""
    names = docs.columns
    cut_id, cuts_ = free_name("_cut_id", names), free_name("_cuts", names)
    cuts = passages.select(F.col(id_col).alias(cut_id), F.struct("passage_start", "passage_end").alias("_cut")).distinct()
    cuts = small(saved(cuts.groupBy(cut_id).agg(F.sort_array(F.collect_list("_cut")).alias(cuts_)), "cuts"))
    joined = docs.join(cuts, F.col(id_col) == F.col(cut_id), "left").drop(cut_id)

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            cut, keep = batch.column(len(names)).to_pylist(), np.ones(len(texts), bool)
            for i, own in enumerate(cut):
                if own:
                    data = np.frombuffer((texts[i] or "").encode(), np.uint8)
                    starts, ends, _ = words(data, np.array([0, len(data)]))
                    gone = np.zeros(len(data), bool)
                    for c in own:
                        a, b = c["passage_start"], min(c["passage_end"], len(starts))
                        if a < b:
                            gone[starts[a]:starts[b] if b < len(starts) else len(data)] = True
                    texts[i] = data[~gone].tobytes().decode()
                    keep[i] = bool(texts[i].strip())
            columns = [*batch.columns[:len(names)]]
            columns[names.index(text_col)] = pa.array(texts, batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
