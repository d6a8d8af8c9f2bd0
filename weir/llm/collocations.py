"""Phrase collocations from sorted streams of counts.

Every word position gives one window: the word and up to three that follow it in its piece, as far as its words and pairs are
frequent. In sorted order all windows that begin with the same words are neighbours, so one pass over the sorted windows counts
the phrases of every length; no phrase is looked up. The counts are then kept twice, in the order of their first parts and in
the order of their last parts, and each order is merged in lockstep with the counts themselves: the first gives the left
counts, the second the right counts, and both the counts of the phrases one word longer.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.arrays import ragged, slices, words
from weir.llm.common import bounded_batches, saved, width

LONGEST = 4
#: Bytes of text whose windows are added up before they are sent on.
SLICE = 1 << 20
#: Bits of the tables of frequent words and pairs that tasks are sent: 16 for each, 32 MB at most.
MOST_BITS = 1 << 28
#: Words hold no blank and no tab, so their bytes under nine can be raised by one; zero then parts words and sorts before all.
CODES = np.arange(256, dtype=np.uint8)
CODES[65:91] += 32
CODES[:9] += 1
for _c in b".,;:!?\n\x0b\x0c\r":
    CODES[_c] = 10
CODES[9] = 32
BACK = np.arange(256, dtype=np.uint8)
BACK[1:10] -= 1
BACK[0] = 32


def coded_words(batch: pa.RecordBatch):
    """Yields (language, distinct words, word numbers, whether the next word continues the piece) for slices of (lang, text) rows."""
    langs = batch.column(0).fill_null("und")
    for lang in langs.unique():
        for _, _, data, offsets in slices(pc.filter(batch.column(1), pc.equal(langs, lang)), SLICE):
            data = CODES[data]
            starts, ends, per_text = words(data, offsets)
            if not len(starts):
                continue
            # a piece ends at a mark or with its text
            piece = np.cumsum(data == 10)[starts]
            joined = np.append(piece[1:] == piece[:-1], False)
            last = per_text[1:][np.diff(per_text) > 0] - 1
            joined[last] = False
            sizes = ends - starts
            flat = data[ragged(starts, sizes)]
            at = np.concatenate(([0], np.cumsum(sizes)))
            coded = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
            yield lang.as_py(), coded.dictionary, coded.indices.to_numpy().astype(np.int64), joined


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): words added up per slice."""
    def run(batches):
        for batch in batches:
            for lang, distinct, number, _ in coded_words(batch):
                counts = np.bincount(number, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), distinct.cast(pa.string()), pa.array(counts, pa.int64())],
                                                 names=["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def code(lang, word):
    return F.crc32(F.concat(lang, F.lit(" "), word).cast("binary"))


#: A pair's place among the bits is made of its words' codes.
PAIR = 1000003


def frequent_bits(frequent: DataFrame, place) -> np.ndarray:
    """A table of bits in which every frequent word or pair has its bit; one whose bit is not set is not frequent.

    Its size follows their number up to MOST_BITS; fuller tables only let more pass, which costs rows, not results.
    """
    bits = 1 << min(max(16, (16 * frequent.count()).bit_length()), MOST_BITS.bit_length() - 1)
    slot = 1 + F.pmod(place, F.lit(bits))
    chunks = (frequent.select(F.bitmap_bucket_number(slot).alias("chunk"), F.bitmap_bit_position(slot).alias("place"))
              .groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in chunks:
        own = np.frombuffer(r["bits"], np.uint8)
        part = out[(r["chunk"] - 1) * len(own):r["chunk"] * len(own)]  # chunks and slots count from one
        part |= own[:len(part)]
    return out


def has_bit(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    slot = place % (8 * len(bits))
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)


def windows(docs: DataFrame, word_bits: np.ndarray, pair_bits: np.ndarray | None = None, longest: int = LONGEST) -> DataFrame:
    """(lang, key, f): each frequent word with the words after it, added up per slice.

    A window has up to `longest` words of a piece and ends before a word that is not frequent or, with `pair_bits`, a pair
    that is not: no frequent phrase goes on there. Without them only windows of `longest` words are given.
    """
    shared = docs.sparkSession.sparkContext.broadcast((word_bits, pair_bits))

    def run(batches):
        word_bits, pair_bits = shared.value
        for batch in batches:
            for lang, distinct, number, joined in coded_words(batch):
                head = f"{lang} ".encode()
                codes = np.array([zlib.crc32(head + w.encode()) for w in distinct.to_pylist()], np.int64)
                known = has_bit(word_bits, codes)[number]
                n, inside, parts = len(number), known, [number + 1]
                follow = np.append(joined & np.append(known[1:], False), np.zeros(longest, bool))
                if pair_bits is not None:
                    own = codes[number]
                    follow[:n - 1] &= has_bit(pair_bits, own[:-1] * PAIR + own[1:])
                ahead = np.append(number + 1, np.zeros(longest, np.int64))
                for j in range(1, longest):
                    inside = inside & follow[j - 1:j - 1 + n]
                    parts.append(np.where(inside, ahead[j:j + n], 0))
                kept = known if pair_bits is not None else inside
                parts = [p[kept] for p in parts]
                if not len(parts[0]):
                    continue
                row = parts[0]
                for p in parts[1:]:  # numbers of the distinct beginnings, so that they stay small
                    row = np.unique(row * (len(distinct) + 1) + p, return_inverse=True)[1]
                _, first, counts = np.unique(row, return_index=True, return_counts=True)
                parts = [p[first] for p in parts]
                size = sum((p > 0).astype(np.int64) for p in parts)
                for k in range(1, longest + 1):
                    own = np.flatnonzero(size == k)
                    if len(own):
                        keys = pc.binary_join_element_wise(*(distinct.take(pa.array(p[own] - 1)) for p in parts[:k]), pa.scalar("\0", distinct.type))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), keys.cast(pa.string()), pa.array(counts[own], pa.int64())],
                                                         names=["lang", "key", "f"])

    return docs.mapInArrow(run, "lang string, key string, f long")


class Runs:
    """Counts the phrases that sorted windows begin with, batch after batch; only the last row and its open runs are kept."""

    def __init__(self, least: int):
        self.least, self.lang, self.key = least, None, b""
        self.open, self.first = np.zeros(LONGEST, np.int64), np.zeros(LONGEST, bool)

    def add(self, langs: pa.Array, keys: pa.Array, counts: np.ndarray):
        """(lang, phrase bytes, words, count, open) of the runs that end in this batch; `open` runs touch the first row."""
        fresh = self.lang is None
        if not fresh:
            langs, keys = pa.concat_arrays([pa.array([self.lang]), langs]), pa.concat_arrays([pa.array([self.key.decode()]), keys])
            counts = np.concatenate(([0], counts))
        keys = keys.cast(pa.large_string())
        n = len(keys)
        at = np.frombuffer(keys.buffers()[1], np.int64, n + 1, keys.offset * 8)
        data = np.frombuffer(keys.buffers()[2], np.uint8)
        at, data = at - at[0], data[at[0]:at[-1]]
        sizes = np.diff(at)
        # the ends of the words of each row
        parts = np.flatnonzero(data == 0)
        row = np.searchsorted(at, parts, "right") - 1
        n_words = np.bincount(row, minlength=n) + 1
        ends = np.zeros((n, LONGEST), np.int64)
        ends[row, np.arange(len(row)) - (np.cumsum(n_words - 1) - n_words + 1)[row]] = parts - at[row]
        ends[np.arange(n), n_words - 1] = sizes
        # bytes that a row has in common with the row before
        both = np.minimum(sizes[1:], sizes[:-1])
        differ = np.flatnonzero(data[ragged(at[:-2], both)] != data[ragged(at[1:-1], both)])
        upto = np.cumsum(both)
        common = both.copy()
        if len(differ):
            where = np.searchsorted(upto, differ, "right")
            pair, first = np.unique(where, return_index=True)
            common[pair] = differ[first] - (upto - both)[pair]
        code = langs.dictionary_encode().indices.to_numpy()
        common = np.where(code[1:] == code[:-1], common, -1)
        out = []
        for k in range(LONGEST):
            own = np.flatnonzero(n_words > k)
            if not len(own):
                self.open[k] = 0
                continue
            end = ends[1:, k]
            same = common >= end
            same &= (sizes[:-1] == end) | (data[np.minimum(at[:-2] + end, len(data) - 1)] == 0)
            same &= (n_words[1:] > k) & (n_words[:-1] > k)
            starts = np.flatnonzero(~np.concatenate(([False], same))[own])
            total = np.add.reduceat(counts[own], starts)
            lead = own[starts]
            edge = np.zeros(len(lead), bool)
            if lead[0] == 0:
                total[0] += self.open[k]
                edge[0] = fresh or self.first[k]
            last_open = own[-1] == n - 1
            closed = len(lead) - last_open
            self.open[k], self.first[k] = (total[-1], edge[-1]) if last_open else (0, False)
            kept = np.flatnonzero((total >= self.least) | edge)
            kept = kept[kept < closed]
            out += [(langs[int(i)].as_py(), data[at[i]:at[i] + ends[i, k]], k + 1, int(t), bool(e))
                    for i, t, e in zip(lead[kept].tolist(), total[kept].tolist(), edge[kept].tolist())]
        self.lang, self.key = langs[n - 1].as_py(), data[at[-2]:at[-1]].tobytes()
        return out

    def end(self):
        """The runs that touch the last row."""
        row, ends = np.frombuffer(self.key, np.uint8), [i for i, c in enumerate(self.key) if c == 0] + [len(self.key)]
        return [(self.lang, row[:end], k + 1, int(self.open[k]), True) for k, end in enumerate(ends)] if self.lang is not None else []


def phrase_counts(sorted_windows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases with f >= least, from windows that are dealt by range and sorted.

    A run inside a partition is whole; runs at an edge of a partition, four at most on each side, are added up afterwards.
    """
    def run(batches):
        runs = Runs(least)

        def rows(found):
            lang, phrase, n, f, edge = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array([BACK[p].tobytes().decode() for p in phrase], pa.string()), pa.array(n, pa.int32()),
                 pa.array(f, pa.int64()), pa.array(edge, pa.bool_())], names=["lang", "phrase", "words", "f", "edge"])

        for batch in batches:
            if batch.num_rows and (found := runs.add(batch.column(0), batch.column(1), batch.column(2).to_numpy())):
                yield rows(found)
        if found := runs.end():
            yield rows(found)

    found = saved(sorted_windows.mapInArrow(run, "lang string, phrase string, words int, f long, edge boolean"), "phrase_runs")
    edges = found.where("edge").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.where("NOT edge").drop("edge").unionByName(edges)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to 4 words of each language.

    Texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs into words, A-Z folded. `a` counts a
    phrase, `n` all words of its language, `l` and `r` the two parts of the cut that scores lowest, with the score
    floor(2000000 * a / (l + r)). Phrases of a < least are no candidates; those inside a longer candidate that occurs in at
    least `covered` hundredths of their places are dropped. Null and empty texts have no words; a null language is `und`;
    repeated rows count each; ties go by count and then by the phrase's bytes; an empty table gives no rows; a word of any
    length is one word; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = saved(word_counts(docs), "word_counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    word_bits = frequent_bits(counted.where(F.col("f") >= least), code("lang", "word"))
    pairs = windows(docs, word_bits, longest=2).groupBy("lang", "key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    first, second = (F.substring_index("key", "\0", i) for i in (1, -1))
    pair_bits = frequent_bits(saved(pairs.select("lang", "key"), "pairs"), code("lang", first) * PAIR + code("lang", second))
    cut = saved(windows(docs, word_bits, pair_bits), "windows")
    in_order = cut.repartitionByRange(width(spark), "lang", "key").sortWithinPartitions("lang", "key")
    counts = saved(phrase_counts(in_order, least), "phrase_counts")

    longer = counts.where("words > 1")
    cuts = longer.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    # the prefix order and the suffix order, each merged with the counts
    lefts = cuts.alias("c").join(part.withColumnsRenamed({"part": "left", "f": "l"}).hint("merge"), ["lang", "left"])
    both = lefts.join(part.withColumnsRenamed({"part": "right", "f": "r"}).hint("merge"), ["lang", "right"])
    score = F.expr(f"(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    # a phrase inside one two words longer is also inside a candidate one word longer that occurs at least as often
    extended = longer.where("words > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = (lowest.join(extended.hint("merge"), ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                             F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
