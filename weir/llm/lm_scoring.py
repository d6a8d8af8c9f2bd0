"""Language-model scores by logistic context mixing.

A text is a sequence of lower-cased words and an end, coded in bits. The most frequent words (`DICTIONARY`), the end and an escape for
all other words stand in the order of their bytes; each bit of a code halves a range of them, so that it says how the word goes
on from the beginning that is known. The bits are predicted along the running text of the training documents: contexts (the last
2 and 4 bytes of the word before, that word, the two words before), hashed with the place in the code, find counts of the bits
that followed there. Their predictions are stretched, weighted by a set of weights that a gate picks (how often the contexts of
words were seen, and the depth in the code), summed and squashed; a table of gate and prediction, filled by what came true, then
refines the result. Ranges with less than 1 of `RANGES` of the training words are not halved further: there words have their share of the counts.

A word behind the escape mixes how often it was seen with how it is spelled: Q(word) = (1 - e) c / N + e S(word), where N counts the
training words behind the escape and e is the share of words seen once among them, the chance of an unseen word. S spells byte by
byte, each byte by the bits of a Huffman code, and mixes `ORDERS` contexts (the place in the word and the last 1, 2, 3, 4 and 6
bytes) in the same way, counted among the distinct training words, as they stand for words not yet seen.

Along a document the result is mixed with the document's own words so far: their share is `OWN` times the share of repeats among
them, so that it follows each text as it is read. Weights and refinement are learnt online, each word predicted from the counts
without itself; tasks learn side by side and their weights are averaged. The tables of bits have a bounded size; the counts of
words grow with the input and are joined.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.arrays import LOWER, SpanHasher, mix, ragged, slices, words
from weir.llm.common import Shared, bounded_batches, fold, saved

#: Bytes of context of each predictor; 0 stands for the place in the word.
ORDERS = (0, 1, 2, 3, 4, 6)
#: Places of each predictor's table of counts.
SLOTS = 1 << 20
#: Gates: contexts seen before (0 to 6) and the place in the word (0 to 3).
GATES = (len(ORDERS) + 1) * 4
#: Steps of the refinement table.
STEPS = 33
RATE = 0.002
#: Words whose counts and scores every task holds: the most frequent ones. The others are joined.
HEAD_WORDS = 500_000
CHUNK, CHUNK_BYTES = 20_000, 1 << 18
#: Words whose score is made at once, so that their bits stay in the processor's cache.
FEW = 4_000
END = 32
LOG10_E = float(np.log10(np.e))
#: Weight of a document's own words for each repeat among them.
OWN = 0.7
#: Words with a code of their own.
DICTIONARY = 1 << 16
#: Codes of words behind the escape and of the end; the dictionary follows.
ESCAPE, LAST = 0, 1
#: Bytes by which the words of the dictionary are put in order.
BEGINNING = 64
RANGES = 1 << 13
#: Most places of each table of counts of the running text, as a power of two. Smaller corpora have 2 to 4 places a word.
PLACES = 21
CONTEXTS = 4
#: Weight of a bit's share in the whole training text when few bits were seen in a context.
SHARE = 2
#: Gates of the running text: times the last word and the last two were seen (none, to 3, to 31, more), and the depth in the code.
STEERS = 4 * 4 * 3
#: Words of running text handled at once.
BLOCK = 2048
#: Numbers in a row of a table of counts on its way to the driver.
PER_ROW = 1 << 14
#: Training text that one task reads.
TASK_BYTES = 128 << 20


def huffman(counts: np.ndarray):
    """(first place, length) of each byte's code in two flat lists of nodes and bits."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, made = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made, made))
        made += 1
    first, length, nodes, bits = [], [], [], []
    for symbol in range(256):
        path, at = [], symbol
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        first.append(len(nodes))
        length.append(len(path))
        for node, bit in reversed(path):
            nodes.append(node)
            bits.append(bit)
    return np.array(first), np.array(length), np.array(nodes, np.int64), np.array(bits, np.int8)


class Spelling:
    """Code, counts, weights and refinement of S."""

    def __init__(self, byte_counts: np.ndarray):
        self.code = huffman(byte_counts)
        self.seen = np.zeros((len(ORDERS), 2, SLOTS), np.uint16)
        self.weights = np.full((GATES, len(ORDERS) + 1), 0.3, np.float32)
        self.refined = np.ones((256, STEPS, 2))
        n = np.arange(256, dtype=np.float32)
        self.stretch = np.log((n[None] + 0.4) / (n[:, None] + 0.4)).astype(np.float32)  # by zeros and ones seen

    def events(self, data: np.ndarray, offsets: np.ndarray):
        """The bits of words that lie one after the other: (slots by order, node, bit, place in the word, word)."""
        n, size = len(offsets) - 1, np.diff(offsets)
        text = np.full(len(data) + n, END, np.int64)
        word = np.repeat(np.arange(n), size + 1)
        place = np.arange(len(text)) - (offsets[:-1] + np.arange(n))[word]
        text[np.flatnonzero(place < size[word])] = data
        first, length, nodes, bits = self.code
        at = ragged(first[text], length[text])
        symbol = np.repeat(np.arange(len(text)), length[text])
        node = nodes[at]
        slots = np.empty((len(ORDERS), len(at)), np.int64)
        with np.errstate(over="ignore"):
            context = np.zeros(len(text), np.uint64)
            for k, order in enumerate(ORDERS):
                if order:
                    for back in range(max(o for o in ORDERS[:k]) + 1, order + 1):
                        before = np.zeros(len(text), np.uint64)
                        before[back:] = text[:-back] + 1 if back < len(text) else 0
                        before[place < back] = 0
                        context = context * np.uint64(0x9E3779B97F4A7C15) + before
                    own = context
                else:
                    own = np.minimum(place, 15).astype(np.uint64)
                own = mix(own + np.uint64((k + 1) * 0xA24BAED4963EE407 & 2**64 - 1))
                slots[k] = ((own[symbol] + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        return slots, node, bits[at], place[symbol], word[symbol]

    def inputs(self, slots, bit, place, without_itself: bool):
        """(stretched predictions and a constant, gate) of each bit."""
        x = np.empty((slots.shape[1], len(ORDERS) + 1), np.float32)
        known = np.zeros(slots.shape[1], np.int64)
        for k in range(len(ORDERS)):
            zeros, ones = self.seen[k, 0][slots[k]].astype(np.int32), self.seen[k, 1][slots[k]].astype(np.int32)
            if without_itself:
                zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
            known += (zeros + ones) > 0
            over = np.maximum(zeros, ones) > 255
            if over.any():
                scale = 255 / np.maximum(np.maximum(zeros[over], ones[over]), 1)
                zeros[over], ones[over] = np.rint(zeros[over] * scale), np.rint(ones[over] * scale)
            x[:, k] = self.stretch[zeros, ones]
        x[:, -1] = 0.3
        return x, known * 4 + np.minimum(place, 3)

    def mixed(self, x, gate) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -12, 12)

    @staticmethod
    def step(dot: np.ndarray):
        at = (dot + 12) * ((STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        return low, at - low

    def learn(self, data, offsets) -> None:
        slots, node, bit, place, _ = self.events(data, offsets)
        x, gate = self.inputs(slots, bit, place, True)
        for a in range(0, len(bit), 4096):
            b = a + 4096
            dot = self.mixed(x[a:b], gate[a:b])
            error = bit[a:b] - 1 / (1 + np.exp(-dot))
            for k in range(x.shape[1]):
                self.weights[:, k] += np.bincount(gate[a:b], RATE * error * x[a:b, k], GATES).astype(np.float32)
            low, part = self.step(dot)
            self.refined += np.bincount((node[a:b] * STEPS + low + (part > 0.5)) * 2 + bit[a:b], minlength=self.refined.size).reshape(
                self.refined.shape)

    def log10(self, data, offsets) -> np.ndarray:
        """log10 S of each word."""
        slots, node, bit, place, word = self.events(data, offsets)
        x, gate = self.inputs(slots, bit, place, False)
        dot = self.mixed(x, gate)
        low, part = self.step(dot)
        prior = 1 / (1 + np.exp(-(np.arange(STEPS) * 24 / (STEPS - 1) - 12)))
        table = (self.refined[..., 1] - 1 + 8 * prior) / (self.refined.sum(2) - 2 + 8)
        refined = table[node, low] * (1 - part) + table[node, low + 1] * part
        p = (1 / (1 + np.exp(-dot)) + refined) / 2
        p = np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1)
        return np.bincount(word, np.log(p), len(offsets) - 1) * LOG10_E


def alphabetic(counts: np.ndarray):
    """(first place, length) of each symbol's code in flat lists of nodes, bits, groups and places there; the share of each node's
    ones; the share of each symbol in the range that its code ends in.

    A node is named after the first symbol of its upper half. Four steps of a code are a group, named after its first node: its 15
    nodes have places 1 to 15, so that their counts lie side by side.
    """
    total = np.concatenate(([0.0], np.cumsum(counts)))
    symbol = np.arange(len(counts))
    lo, hi = np.zeros(len(counts), np.int64), np.full(len(counts), len(counts))
    ones, steps = np.full(len(counts), 0.5), []
    group, inside = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    while True:
        whole = total[hi] - total[lo]
        at = np.flatnonzero((hi - lo > 1) & (whole * RANGES >= total[-1]))
        if not len(at):
            break
        a, b = lo[at], hi[at]
        half = (total[a] + total[b]) / 2
        middle = np.searchsorted(total, half)
        middle -= half - total[middle - 1] < total[middle] - half
        middle = np.clip(middle, a + 1, b - 1)
        ones[middle] = (total[b] - total[middle]) / whole[at]
        bit = symbol[at] >= middle
        if len(steps) % 4 == 0:
            group[at], inside[at] = middle, 1
        steps.append((at, middle, bit, group[at], inside[at]))
        inside[at] = 2 * inside[at] + bit
        lo[at], hi[at] = np.where(bit, middle, a), np.where(bit, b, middle)
    of, nodes, bits, groups, places = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(of, kind="stable")
    length = np.bincount(of, minlength=len(counts))
    return (np.cumsum(length) - length, length, nodes[order], bits[order], groups[order], places[order]), ones, counts / whole


class Running:
    """Code, counts, weights and refinement of the running text."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, places: int):
        """Of the dictionary's hashes in the order of the words' bytes, counts of the escape, the end and those words."""
        self.hashes, self.places = hashes, places
        self.code, ones, rest = alphabetic(counts + 0.5)
        self.rest = np.log10(rest)
        self.ones, self.stretched = ones.astype(np.float32), np.log(ones / (1 - ones)).astype(np.float32)
        *_, groups, places_ = self.code
        self.code = self.code[:4]
        # the place of a bit is the sum of a context's hash and this number: a hash of the group, and the place in it in four bits
        self.salt = (mix(groups.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) << np.uint32(4) | places_.astype(np.uint32)
        depth = np.arange(len(groups)) - np.repeat(*self.code[:2])
        self.depth = (((depth > 2).astype(np.int8) + (depth > 6)) * 16).astype(np.int8)
        self.weights = np.zeros((CONTEXTS + 2, STEERS), np.float32)
        self.weights[:CONTEXTS], self.weights[CONTEXTS] = 0.25, 1
        self.refined = np.ones((STEERS, STEPS, 2))
        self.seen = None

    def text(self, data, starts, ends, per_text, hashes, symbols):
        """(contexts, symbols, place of each word, place of each end) of texts, one after the other, each with its end."""
        docs = len(per_text) - 1
        at = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(per_text))
        last = per_text[1:] + np.arange(docs)
        symbol, word, tail = np.full(len(at) + docs, LAST), np.zeros(len(at) + docs, np.uint64), np.zeros(len(at) + docs, np.uint64)
        symbol[at], word[at] = symbols, hashes
        ending, size = np.zeros(len(at), np.uint32), np.minimum(ends - starts, 4)
        for back in range(1, 5) if len(at) else ():
            ending |= data.take(ends - back, mode="clip").astype(np.uint32) << np.uint32(8 * (back - 1))
        short = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size]
        tail[at] = ending & short | np.uint32(END * 0x01010101) & ~short

        def before(x):  # zero stands before a text: it is what an end has
            return np.concatenate((np.zeros(1, np.uint64), x[:-1])) if len(x) else x

        one, tail = before(word), before(tail)
        two = before(one)
        two[last[:-1] + 1] = 0
        with np.errstate(over="ignore"):
            contexts = [mix(x + np.uint64((k + 1) * 0xA24BAED4963EE407 & 2**64 - 1)) >> np.uint64(32) for k, x in enumerate(
                (tail & np.uint64(0xFFFF), tail, one, one * np.uint64(0x9E3779B97F4A7C15) + two))]
        return [c.astype(np.uint32) << np.uint32(4) for c in contexts], symbol, at, last

    def blocks(self, contexts, symbol):
        """Yields (first word, first bit of each word, gate of each bit's depth, node, bit, slots by context).

        Here and below all places lie within their tables; mode="clip" only spares the test of it.
        """
        first, length, nodes, bits = self.code
        mask = np.uint32((1 << self.places) - 1)
        for a in range(0, len(symbol), BLOCK):
            own = symbol[a:a + BLOCK]
            size = length[own]
            begin = np.cumsum(size) - size
            at = np.repeat(first[own] - begin, size)
            at += np.arange(len(at))
            salt = self.salt.take(at, mode="clip")
            yield a, begin, self.depth.take(at, mode="clip"), nodes.take(at, mode="clip"), bits.take(at, mode="clip"), [
                ((np.repeat(c[a:a + BLOCK], size) + salt) & mask).astype(np.intp) for c in contexts]

    def inputs(self, depth, node, bit, slots, without_itself: bool):
        """(stretched predictions by context as far as they leave the bit's share, that share stretched, gate) of each bit."""
        share, one = self.stretched.take(node, mode="clip"), np.float32(SHARE) * self.ones.take(node, mode="clip")
        zero, x, gate = np.float32(SHARE) - one, [], depth.copy()
        if without_itself:  # it was counted, so its count is at least 1
            itself = bit.astype(np.uint32) * np.uint32(65535) + np.uint32(1)
        for k in range(CONTEXTS):
            pair = self.seen[k].take(slots[k], mode="clip")
            if without_itself:
                pair -= itself
            zeros, ones = (pair & np.uint32(0xFFFF)).astype(np.float32), (pair >> np.uint32(16)).astype(np.float32)
            if k >= CONTEXTS - 2:
                n = zeros + ones
                known = (n > 0).view(np.int8) + (n > 3).view(np.int8) + (n > 31).view(np.int8)
                gate += known * np.int8(4) if k == CONTEXTS - 1 else known
            ones += one
            zeros += zero
            x.append(np.log(ones / zeros) - share)
        return x, share, gate.astype(np.intp)

    def mixed(self, x, share, gate) -> np.ndarray:
        dot = share * self.weights[CONTEXTS].take(gate, mode="clip") + self.weights[CONTEXTS + 1].take(gate, mode="clip")
        for k in range(CONTEXTS):
            dot += x[k] * self.weights[k].take(gate, mode="clip")
        return np.clip(dot, np.float32(-11.9), np.float32(11.9))

    @staticmethod
    def step(dot: np.ndarray, gate: np.ndarray):
        """(place in the refinement table, part of the way to the next one)."""
        at = (dot + np.float32(12)) * np.float32((STEPS - 1) / 24)
        low = at.astype(np.int32)
        return gate * STEPS + low, at - low.astype(np.float32)

    def learn(self, contexts, symbol, pace: np.ndarray) -> None:
        """Moves the weights along the errors, by less the more a weight was moved before (`pace`)."""
        for _, _, depth, node, bit, slots in self.blocks(contexts, symbol):
            x, share, gate = self.inputs(depth, node, bit, slots, True)
            dot = self.mixed(x, share, gate)
            error = bit - 1 / (1 + np.exp(-dot))
            steps = np.array([np.bincount(gate, error * i, STEERS) for i in (*x, share)] + [np.bincount(gate, error, STEERS)])
            pace += steps * steps
            self.weights += (0.02 * steps / np.sqrt(pace + 1)).astype(np.float32)
            at, part = self.step(dot, gate)
            self.refined += np.bincount((at + (part > 0.5)) * 2 + bit, minlength=self.refined.size).reshape(self.refined.shape)

    def log10(self, contexts, symbol) -> np.ndarray:
        """log10 of the probability of each symbol."""
        prior = 1 / (1 + np.exp(-(np.arange(STEPS) * 24 / (STEPS - 1) - 12)))
        table = ((self.refined[..., 1] - 1 + 8 * prior) / (self.refined.sum(2) - 2 + 8)).astype(np.float32).ravel()
        out = self.rest[symbol]
        for a, begin, depth, node, bit, slots in self.blocks(contexts, symbol):
            x, share, gate = self.inputs(depth, node, bit, slots, False)
            dot = self.mixed(x, share, gate)
            at, part = self.step(dot, gate)
            low = table.take(at, mode="clip")
            p = (1 / (1 + np.exp(-dot)) + low + (table.take(at + 1, mode="clip") - low) * part) / 2
            p = np.clip(np.abs(p - ~bit), np.float32(1e-9), np.float32(1))
            out[a:a + len(begin)] += np.add.reduceat(np.log(p), begin) * LOG10_E
        return out


def chunks(column, limit: int = CHUNK):
    """(row of each word, bytes, offsets) of runs of up to `limit` words and CHUNK_BYTES bytes of a binary column.

    A longer word is spelled as several, so that no word needs more memory than a run of short ones.
    """
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    pieces = np.maximum(1, -(-np.diff(offsets) // CHUNK_BYTES))
    row = np.repeat(np.arange(len(column)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts, a = np.append(offsets[row] + number * CHUNK_BYTES, offsets[-1]), 0
    while a < len(row):
        b = min(a + limit, max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK_BYTES, "right")) - 1), len(row))
        yield row[a:b], data[cuts[a]:cuts[b]], cuts[a:b + 1] - cuts[a]
        a = b


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, hash, c): the distinct words of (text, train), with their number in training texts."""
    def run(batches):
        hasher, held, n = SpanHasher(), [], 0

        def out():
            h, c = (np.concatenate([p[i] for p in held]) for i in range(2))
            sizes, data = (np.concatenate([p[i] for p in held]) for i in (2, 3))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            starts = (np.cumsum(sizes) - sizes)[first]
            offsets = np.concatenate(([0], np.cumsum(sizes[first])))
            word = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(
                np.ascontiguousarray(data[ragged(starts, sizes[first])]))])
            return pa.RecordBatch.from_arrays(
                [word, pa.array(u.view(np.int64)), pa.array(np.bincount(back, c, len(u)).astype(np.int64))],
                names=["word", "hash", "c"])

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(0)):
                data = LOWER[data]
                starts, ends, per_text = words(data, offsets)
                h = hasher(data, starts, ends)
                learnt = np.repeat(train[lo:hi], np.diff(per_text))
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                sizes = (ends - starts)[first]
                held.append((u, np.bincount(back, learnt, len(u)), sizes, data[ragged(starts[first], sizes)]))
                n += len(u)
                if n > 1_000_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "word binary, hash long, c long").groupBy("word", "hash").agg(F.sum("c").alias("c"))


def filled(counted: DataFrame, shape: tuple) -> np.ndarray:
    """The sums of tables of zeros and ones that tasks counted, (part of `PER_ROW` numbers, 32-bit counts), as pairs of 16 bits."""
    def total(batches):
        at, own = None, None
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(n, np.int32).astype(np.int64)
                if part != at:
                    if at is not None:
                        yield _part(at, own)
                    at, own = part, np.zeros(PER_ROW, np.int64)
                own += n
        if at is not None:
            yield _part(at, own)

    flat = np.zeros(shape, np.uint16).reshape(-1, PER_ROW)
    parts = counted.repartition("part").sortWithinPartitions("part")
    for r in parts.mapInArrow(total, "part long, n binary").toLocalIterator():
        flat[r["part"]] = np.frombuffer(r["n"], np.uint16)
    return flat.reshape(shape)


def parts_of(table: np.ndarray):
    """The rows of `PER_ROW` numbers of a flat table that have any, in batches."""
    flat = table.reshape(-1, PER_ROW)
    some = np.flatnonzero(flat.any(1))
    for a in range(0, len(some), 64):
        yield pa.RecordBatch.from_arrays([pa.array(some[a:a + 64]), pa.array([flat[i].tobytes() for i in some[a:a + 64]], pa.binary())],
                                         names=["part", "n"])


class Learnt:
    """A model whose counts were sent to the executors once; weights and refinement, which are small, travel with the functions."""

    def __init__(self, shared: Shared, weights: np.ndarray, refined: np.ndarray):
        self.shared, self.weights, self.refined = shared, weights, refined

    @property
    def value(self):
        model = copy.copy(self.shared.value)
        model.weights, model.refined = self.weights.copy(), self.refined.copy()
        return model


def learnt(model, shared: Shared, learners: DataFrame) -> Learnt:
    """The model with the mean weights and the summed refinement of (symbols learnt, weights, refinement) of several tasks."""
    weights, refined = model.weights, model.refined
    rows = [r for r in learners.collect() if r["n"]]
    if rows:
        share = np.array([r["n"] for r in rows]) / sum(r["n"] for r in rows)
        w = [np.frombuffer(r["w"], np.float32).reshape(weights.shape) for r in rows]
        weights = sum(s * x for s, x in zip(share, w)).astype(np.float32)
        refined = sum(np.frombuffer(r["r"], np.float64).reshape(refined.shape) - 1 for r in rows) + 1
    return Learnt(shared, weights, refined)


def fit_spelling(vocabulary: DataFrame) -> Learnt:
    """Counts, weights and refinement from the training words (c > 0) of a vocabulary."""
    spark = vocabulary.sparkSession
    seen_words = vocabulary.filter("c > 0").select("word").repartition(spark.sparkContext.defaultParallelism)

    def byte_counts(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(data, minlength=256)
                total[END] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    rows = vocabulary.filter("c > 0").select("word").mapInArrow(byte_counts, "n binary").collect()
    model = Spelling(sum((np.frombuffer(r["n"], np.int64) for r in rows), np.zeros(256, np.int64)))
    code_only = spark.sparkContext.broadcast(model.code)

    def count(batches):
        m = Spelling.__new__(Spelling)
        m.code = code_only.value
        total = np.zeros((len(ORDERS), 2, SLOTS), np.int32)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                slots, _, bit, _, _ = m.events(data, offsets)
                for k in range(len(ORDERS)):
                    for b in (0, 1):
                        total[k, b] += np.bincount(slots[k][bit == b], minlength=SLOTS).astype(np.int32)
        yield from parts_of(np.ascontiguousarray(np.moveaxis(total, 1, 2)))  # zeros and ones of a place side by side

    counted = seen_words.mapInArrow(count, "part long, n binary")
    model.seen = np.ascontiguousarray(np.moveaxis(filled(counted, (len(ORDERS), SLOTS, 2)), 2, 1))
    shared = Shared(spark, model)
    untaught = Learnt(shared, model.weights, model.refined)

    def learn(batches):
        m, n = untaught.value, 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                m.learn(data, offsets)
                n += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m.weights.tobytes()]), pa.array([m.refined.tobytes()])],
                                         names=["n", "w", "r"])

    return learnt(model, shared, seen_words.mapInArrow(learn, "n long, w binary, r binary"))


def _part(at: int, own: np.ndarray) -> pa.RecordBatch:
    """Pairs of counts as 16 bits; the zeros and ones of a place over that shrink by one factor, a count that is there stays."""
    pairs = own.reshape(-1, 2)
    top = np.maximum(pairs.max(1, keepdims=True), 65535)
    narrow = np.maximum(np.rint(pairs * (65535 / top)), pairs > 0).astype(np.uint16)
    return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([narrow.tobytes()])], names=["part", "n"])


def own_words(hashes: np.ndarray, per_text: np.ndarray):
    """(chance left to the corpus, chance given by the document's own words) of each word, and the first at each end."""
    doc, n = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text)), len(hashes)
    order = np.lexsort((hashes, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    starts = np.flatnonzero(new)
    before = np.empty(n)
    before[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    repeats = np.concatenate(([0], np.cumsum(before > 0)))
    place, hits = np.arange(n) - per_text[doc], repeats[:-1] - repeats[per_text[doc]]
    share = OWN * (hits + 1) / (place + 4)
    size = np.diff(per_text)
    ends = OWN * (repeats[per_text[1:]] - repeats[per_text[:-1]] + 1) / (size + 4)
    return 1 - share, share * before / np.maximum(place, 1), 1 - ends


class Places:
    """Hash table of the rows of different hashes."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(hashes) + 2))))
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.at[slot[todo]] < 0
            taken, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[taken], self.at[taken] = hashes[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.at[slot]
        todo = np.flatnonzero((at >= 0) & (self.keys[slot] != hashes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at[todo] = self.at[slot[todo]]
            todo = todo[(at[todo] >= 0) & (self.keys[slot[todo]] != hashes[todo])]
        return at


class Head(Places):
    """Count, model score and code by hash of the words that are not joined."""

    def __init__(self, packed: list[bytes], codes: "Codes"):
        hashes, self.counts, self.model = (np.concatenate([np.zeros(0, t), *(np.frombuffer(p[i], t) for p in packed)]) for i, t in (
            (0, np.uint64), (1, np.int64), (2, np.float64)))
        super().__init__(hashes)
        self.symbols = codes(hashes)


class Codes(Places):
    """The symbol of each word hash: the escape, or a place in the dictionary."""

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.find(hashes)
        return np.where(at < 0, ESCAPE, at + LAST + 1)


def packed_columns(batches):
    """Each batch as one row of little-endian columns."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()]) for c in batch.columns], names=["h", "c", "m"])


#: Steps of a quarter of a power of two of a count, so few numbers reach the driver.
LEVEL = "floor(log2(c) * 4)"


def least_level(levels: list, limit: int) -> int:
    """The least of (level, words) from the highest on that leaves up to `limit` words; one that no word has, if there is none."""
    least, total = 1 << 62, 0
    for level, words_ in levels:
        total += words_
        if total > limit:
            break
        least = level
    return least


def fit_running(training: DataFrame, words_: list, n: int, ends: int) -> Learnt:
    """Counts, weights and refinement from the running text of (text), given (beginning of the word, hash, c) of the dictionary and
    the numbers of training tokens and of ends among them."""
    spark = training.sparkSession
    words_ = sorted(words_)
    counts = np.array([0, ends] + [c for _, _, c in words_], np.float64)
    counts[ESCAPE] = n - counts.sum()
    model = Running(np.array([h for _, h, _ in words_], np.int64).view(np.uint64), counts,
                    min(PLACES, max(13, int(np.ceil(np.log2(2 * n + 1))))))
    code_only = Shared(spark, model)

    def texts(m, batches):
        hasher, codes = SpanHasher(), Codes(m.hashes)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                data = LOWER[data]
                starts, ends_, per_text = words(data, offsets)
                h = hasher(data, starts, ends_)
                contexts, symbol, _, _ = m.text(data, starts, ends_, per_text, h, codes(h))
                yield contexts, symbol

    def count(batches):
        m = code_only.value
        seen, one = np.zeros((CONTEXTS, 2 << m.places), np.int32), np.ones(0, np.int32)
        for contexts, symbol in texts(m, batches):
            for _, _, _, _, bit, slots in m.blocks(contexts, symbol):
                if len(one) < len(bit):
                    one = np.ones(len(bit), np.int32)
                for k in range(CONTEXTS):
                    np.add.at(seen[k], slots[k] * 2 + bit, one[:len(bit)])
        yield from parts_of(seen)

    seen = filled(training.mapInArrow(count, "part long, n binary"), (CONTEXTS, 1 << model.places, 2))
    model.seen = seen.view(np.uint32)[..., 0]
    shared = Shared(spark, model)
    untaught = Learnt(shared, model.weights, model.refined)

    def learn(batches):
        m, n, pace = untaught.value, 0, np.zeros((CONTEXTS + 2, STEERS))
        for contexts, symbol in texts(m, batches):
            m.learn(contexts, symbol, pace)
            n += len(symbol)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m.weights.tobytes()]), pa.array([m.refined.tobytes()])],
                                         names=["n", "w", "r"])

    return learnt(model, shared, training.mapInArrow(learn, "n long, w binary, r binary"))


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, class_score, bits_per_byte) of every row.

    Learns from all rows whose crc32 of the id modulo 5 is not 1. `base_score` is the sum of log10 of the tokens' smoothed
    shares, `score` the model's log10 probability of words and end, `class_score` the same with all unknown words as one token, as
    the base takes them, `bits_per_byte` the score in bits over the words' bytes, each with
    one for its end. A null or empty text is its end alone; repeated rows count and are scored each; an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = fold(id_col, 5) == 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    training = rows.filter(~F.col("held_out")).select("text")
    ends, size = training.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect()[0]
    vocabulary = saved(word_counts(rows.select("text", (~F.col("held_out")).alias("train"))), "vocabulary")
    n, v, once = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).collect()[0]
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    level = F.expr(LEVEL)
    levels = [tuple(r) for r in vocabulary.filter("c > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()]
    # words seen once have no code: they stand for those never seen
    coded = level >= F.lit(max(1, least_level(levels, DICTIONARY)))
    dictionary = [(bytes(r[0]), r[1], r[2]) for r in vocabulary.filter("c > 0").filter(coded).select(
        F.substring("word", 1, BEGINNING), "hash", "c").collect()]
    behind = n - ends - sum(c for _, _, c in dictionary)
    escape = ((once or 0) + 1) / (behind + 2)
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))
    along = fit_running(training.coalesce(parts), dictionary, n, ends)
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    spelling = fit_spelling(vocabulary)

    def spell(batches):
        spelled = spelling.value
        for batch in batches:
            c = batch.column(2).to_numpy().astype(float)
            s = np.zeros(len(c))
            for of, data, offsets in chunks(batch.column(0), FEW):
                np.add.at(s, of, spelled.log10(data, offsets))
            s += np.log10(escape)
            seen = np.log10(np.maximum((1 - escape) * c / max(behind, 1), 1e-300))
            model = np.where(c > 0, np.logaddexp(s * np.log(10), seen * np.log(10)) / np.log(10), s)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(base_of(c)), pa.array(model)],
                                             names=["hash", "c", "base", "model"])

    scored = saved(vocabulary.mapInArrow(spell, "hash long, c long, base double, model double"), "words")
    frequent = (F.col("c") > 0) & (coded | (level >= F.lit(least_level(levels, head_words))))
    head = spark.sparkContext.broadcast([tuple(r) for r in scored.filter(frequent).select("hash", "c", "model").mapInArrow(
        packed_columns, "h binary, c binary, m binary").collect()])
    end_base = float(base_of(ends))

    def score(batches):
        mixing = along.value
        hasher, head_ = SpanHasher(), Head(head.value, Codes(mixing.hashes))
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                data = LOWER[data]
                starts, ends_, per_text = words(data, offsets)
                h = hasher(data, starts, ends_)
                at = head_.find(h)
                hit = at >= 0
                left, own, left_at_end = own_words(h, per_text)
                base, model = np.zeros(len(h)), np.zeros(len(h))
                base[hit], model[hit] = base_of(head_.counts[at[hit]]), head_.model[at[hit]]
                symbols = np.where(hit, head_.symbols[at], ESCAPE) if len(head_.symbols) else np.full(len(h), ESCAPE)
                contexts, symbol, of_word, of_end = mixing.text(data, starts, ends_, per_text, h, symbols)
                coded_ = mixing.log10(contexts, symbol)
                left *= 10 ** coded_[of_word]
                model = np.where(symbols == ESCAPE, model, 0)
                model = np.where(hit, np.where(own > 0, np.log10(left * 10 ** model + np.maximum(own, 1e-300)), np.log10(left) + model), 0)
                sums = []
                for column in (hit.astype(float), base, model):
                    running = np.concatenate(([0], np.cumsum(column)))
                    sums.append(running[per_text[1:]] - running[per_text[:-1]])
                size = np.concatenate(([0], np.cumsum(ends_ - starts + 1)))
                rare = np.concatenate(([0], np.cumsum(~hit)))[per_text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo),
                     pa.array(np.diff(per_text)), pa.array(size[per_text[1:]] - size[per_text[:-1]]),
                     pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2] + np.log10(left_at_end) + coded_[of_end]),
                     pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.StructArray.from_arrays(
                         [pa.array(h[~hit].view(np.int64)), pa.array(np.maximum(left[~hit], 1e-37).astype(np.float32)), pa.array(own[~hit].astype(np.float32))],
                         names=["hash", "left", "own"]))],
                    names=["row", "id", "held_out", "n", "bytes", "known", "base", "model", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    first = saved(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text", "held_out").mapInArrow(
        score, f"row long, id {kind}, held_out boolean, n long, bytes long, known long, base double, model double, rare array<struct<hash:long,left:float,own:float>>"),
        "scored")
    rare = first.select("row", F.inline("rare"))
    # a word that the document has not had yet is added in logs, as the chance of a long one is too small for a double
    mixed = lambda p: F.sum(F.when(F.col("own") > 0, F.log10(F.col("left") * F.pow(F.lit(10.0), p) + F.col("own"))).otherwise(
        F.log10("left") + p))
    rest = rare.join(scored.filter(~frequent), "hash").groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("known_"), F.sum("base").alias("base_"), mixed(F.col("model")).alias("model_"),
        mixed(F.when(F.col("c") > 0, F.col("model")).otherwise(F.lit(float(np.log10(escape))))).alias("class_"))
    whole = first.drop("rare").join(rest, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    model = add("model", "model_")
    return whole.select(
        F.col("id").alias(id_col), "held_out", (F.col("n") + 1).alias("n_tokens"),
        (add("known", "known_") + F.lit(1 if ends else 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (add("base", "base_") + F.lit(end_base)).alias("base_score"), model.alias("score"),
        add("model", "class_").alias("class_score"),
        (-model / F.lit(float(np.log10(2))) / (F.col("bytes") + 1)).alias("bits_per_byte"))
