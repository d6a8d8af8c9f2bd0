"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

Documents with the same set of shingles are one class. A class's set is hashed once into `BINS` bins; an empty bin
takes the value of the first filled bin on its own random tour of all bins, the same tour for every document. Classes that
agree in all `ROWS` bins of a band share a bucket. A bucket is compared as a star, its centre with the members that are not yet in the
centre's component; buckets that still hold several components get further centres, until every pair of a bucket is either in
one component or was compared; there, pairs whose bits differ in so many bins as a linked pair's would once in two million
are not, nor pairs whose odd sketches differ in more places than a linked pair's sets have shingles that they do not share.
Comparisons count the shared shingles of the whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.arrays import LOWER, SpanHasher, mix, shingles, slices, words
from weir.llm.common import bounded_batches, saved, small
from weir.llm.components import components

BANDS, ROWS = 64, 6
#: Bins of a signature; one bit of each stands in a class's row, to rule out pairs far below the limit.
BINS = 512
#: Places of an odd sketch: each holds whether an odd number of a set's shingles fall on it.
ODD = 1024
#: Texts whose signatures are made at once: a slice of short texts has many, and each takes some 20 KB.
RUN = 512
#: Members compared with one copy of a centre's text, and centres that a bucket gets in one turn.
STAR, TURN = 64, 256


def document_sets(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, k: int):
    """(sorted distinct shingle hashes of all texts, their offsets)."""
    data = LOWER[data]
    starts, ends, per_text = words(data, offsets)
    h, at = shingles(hasher(data, starts, ends), per_text, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[at]


def set_runs(texts: pa.Array, hasher: SpanHasher, k: int):
    """(first row, row past the last, hashes, offsets) of the sets of up to RUN texts."""
    for lo, hi, data, offsets in slices(texts):
        h, at = document_sets(data, offsets, hasher, k)
        for a in range(0, hi - lo, RUN):
            b = min(a + RUN, hi - lo)
            yield lo + a, lo + b, h[at[a]:at[b]], at[a:b + 1] - at[a]


def marks(h: np.ndarray, at: np.ndarray):
    """Two independent sums over each set: equal for equal sets."""
    def summed(x):
        total = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
        return (total[at[1:]] - total[at[:-1]]).view(np.int64)

    with np.errstate(over="ignore"):
        return summed(mix(h + np.uint64(0x1234567))), summed(mix(h ^ np.uint64(0x9E3779B97F4A7C15)))


def signatures(h: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` values for each set; 0 where the set is empty."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    own = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
    sig, filled = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    sig[of[first], own[first]] = h[first]
    filled[of[first], own[first]] = True
    tours = np.argsort(mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins), 1)
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    for t in range(bins):
        if not len(row):
            break
        to = tours[col, t]
        hit = filled[row, to]
        sig[row[hit], col[hit]] = sig[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig[:, :bands * ROWS].reshape(len(sig), bands, -1)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), parts.shape[:2]).copy()
        for j in range(parts.shape[2]):
            key = mix(key ^ parts[:, :, j]) + np.uint64(j)
    return key.view(np.int64)


def bin_bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each bin: equal in equal bins, else as often as not."""
    bits = (mix(sig ^ np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def odd_sketch(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parities of the shingles at each place. Two sets' sketches differ in no more places than the shingles that only one has."""
    n = len(at) - 1
    place = np.repeat(np.arange(n), np.diff(at)) * ODD + (mix(h ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(ODD)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * ODD) & 1).astype(np.uint8).reshape(n, ODD)
    return np.ascontiguousarray(np.packbits(odd, axis=1)).view(np.int64)


def most_differing(percent: int) -> int:
    """Bits in which a pair just at the limit differs at most: the mean and five standard deviations."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(BINS * p + 5 * np.sqrt(BINS * p * (1 - p))))


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, bands, bits): set size, set marks, bucket keys and bits of every row, those of the bins and the odd sketch; an
    empty set has no buckets."""
    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            for lo, hi, h, at in set_runs(batch.column(1), hasher, k):
                s1, s2 = marks(h, at)
                n = np.diff(at)
                sig = signatures(h, at, BINS)
                keys, bits = band_keys(sig, BANDS)[n > 0], np.concatenate((bin_bits(sig), odd_sketch(h, at)), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n > 0) * BANDS)), pa.int32()),
                                              pa.array(keys.ravel())),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))],
                    names=["id", "n", "s1", "s2", "bands", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, s1 long, s2 long, bands array<long>, bits array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets share enough shingles. `pairs` also has a_s1 and b_s1, the marks of both sets."""
    stars = small(saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_n")), "stars"))
    dealt = pairs.join(stars, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_n")))
    wanted = small(saved(
        dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id"), F.col("b_s1").alias("s1"))
        .union(dealt.select("a", "part", F.lit(0), "a", "a_s1").distinct()), "wanted"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = texts.join(wanted, "id").select("a", "part", "role", "id", "s1", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")

    def run(batches):
        hasher, star, centre = SpanHasher(), None, None
        for batch in batches:
            a, part, role, own, mark = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            out_a, out_b = [], []
            for lo, hi, data, offsets in slices(batch.column(5)):
                h, at = document_sets(data, offsets, hasher, k)
                s1, _ = marks(h, at)
                for i in np.flatnonzero(s1 == mark[lo:hi]).tolist():  # rows of one id may have other texts
                    j, mine = lo + i, h[at[i]:at[i + 1]]
                    if role[j] == 0:
                        star, centre = (a[j], part[j]), mine.copy()
                    elif star == (a[j], part[j]):
                        both = np.concatenate((centre, mine))
                        both.sort()
                        shared = int((both[1:] == both[:-1]).sum())
                        if 100 * shared >= percent * (len(both) - shared):
                            out_a.append(a[j])
                            out_b.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: documents are linked whose sets of `k`-word shingles share
    `percent` hundredths of their union.

    Words are lower-cased (A-Z) and end at white space; fewer words than `k` are one shingle. A document without words is
    linked with nothing. `component_id` is the smallest id reachable; ties need no rule. Rows of one id are separate texts
    with one node name; a row without an id is kept, linked with nothing, and has no component. An empty table gives no rows.
    The chance that a pair at 75 hundredths shares no bucket is 4e-6 (64 bands of 6 rows); more similar pairs have less.
    """
    bounded_batches(docs.sparkSession)
    sketch = saved(sketches(docs, k, id_col, text_col), "sketches")
    classes = saved(sketch.filter("id is not null and n > 0").groupBy("n", "s1", "s2").agg(
        F.min("id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")), "classes")
    keys = classes.select("node", "n", "s1", F.explode("bands").alias("key"))
    shared = small(saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared"))
    members = saved(keys.join(shared, "key"), "members")
    fits = F.least("n", "a_n") * 100 >= F.greatest("n", "a_n") * percent
    pair = ["a", "a_s1", F.col("node").alias("b"), F.col("s1").alias("b_s1")]

    # the first centre is the member that shares most buckets with others
    weights = small(saved(members.groupBy("node").agg(F.sum("c").alias("weight")), "weights"))
    first = members.join(weights, "node").groupBy("key").agg(
        F.max(F.struct("weight", "node", "n", "s1")).alias("_c"))
    centres = saved(first.select("key", F.col("_c.node").alias("a"), F.col("_c.n").alias("a_n"), F.col("_c.s1").alias("a_s1")),
                    "centres")
    tested = saved(members.join(small(centres), "key").filter((F.col("node") != F.col("a")) & fits).select(*pair).distinct(), "pairs")
    links = saved(confirmed(docs, tested, k, percent, id_col, text_col), "confirmed")
    labels = components(links)
    bits = classes.select("node", "bits")
    differing, odd = (sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("a_bits")[i])) for i in places)
                      for places in (range(BINS // 64), range(BINS // 64, (BINS + ODD) // 64)))
    # sets of n and m shingles that share `percent` hundredths have at most (n + m) (100 - percent) / (100 + percent) that only one has
    alike = (differing <= most_differing(percent)) & (odd * (100 + percent) <= (F.col("n") + F.col("a_n")) * (100 - percent))
    left, turn = members, 0
    while True:
        # members that were no centre in their bucket; a bucket is done when they are of one component
        used = small(centres).select("key", F.col("a").alias("node"))
        left = left.select("key", "node", "n", "s1").join(used, ["key", "node"], "left_anti")
        known = saved(left.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "known")
        kin = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("kin"))
        undone = small(saved(kin.groupBy("key").agg(
            F.max(F.struct("kin", "comp"))["comp"].alias("top"), (F.sum("kin") - F.max("kin")).alias("others")).filter("others > 0"), "undone"))
        left = saved(known.join(undone, "key").join(bits, "node"), "left")
        if not left.limit(1).count():
            break
        # all members outside the largest component become centres, of many as many as a turn takes
        ticket = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20))
        centres = saved(left.filter((F.col("comp") != F.col("top")) & (ticket * F.col("others") < F.lit(TURN << 20))).select(
            "key", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("s1").alias("a_s1"), F.col("comp").alias("a_comp"),
            F.col("bits").alias("a_bits")), "centres")
        new = saved(left.join(small(centres), "key").filter(
            (F.col("comp") != F.col("a_comp")) & fits & alike).select(*pair).distinct(), "near")
        seen = small(tested.select("a", "b"))
        new = new.join(seen, ["a", "b"], "left_anti").join(
            seen.select(F.col("a").alias("_b"), F.col("b").alias("_a")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
        new = saved(new, "pairs")
        if new.limit(1).count():
            found = saved(confirmed(docs, new, k, percent, id_col, text_col), "confirmed")
            if found.limit(1).count():
                links = saved(links.union(found), "confirmed")
                labels = components(links, labels)
            tested = tested.union(new)
        centres, turn = centres.select("key", "a", "a_n", "a_s1"), turn + 1
    roots = classes.select("n", "s1", "s2", "node").join(small(labels), "node", "left").select(
        "n", "s1", "s2", F.coalesce("comp", "node").alias("_root"))
    placed = sketch.select("id", "n", "s1", "s2").join(roots, ["n", "s1", "s2"], "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("_root", "id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"),
                         F.col("id").eqNullSafe(root).alias("kept"))
