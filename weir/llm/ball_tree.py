"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, a score their inner product. Only
coordinates that some query of the block has can add to a score, so the vectors hold those alone. Tasks build a tree over each
few thousand documents they read: a ball is a centroid and a radius, and no document in it scores above
`<query, centroid> + |query| * radius`. Subtrees are opened best bound first and dropped once that bound is under the score a
query needs; documents of a leaf are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.arrays import SpanHasher, ragged, slices, words
from weir.llm.common import bounded_batches, saved

#: Bytes of terms are digits, letters and all beyond ASCII; only A-Z are folded.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[48:58] = np.arange(48, 58)
TERM_BYTES[97:123] = TERM_BYTES[65:91] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)
#: Relative slack of bounds and squared distances: far above what sums of a million rounded products can be off.
SLACK = 1e-9
LEAF, BLOCK_ROWS = 64, 4096
#: Numbers in one matrix (32 MB), and postings of a block of documents.
CELLS, POSTINGS = 1 << 22, 1 << 22
#: Bytes of query text whose terms are searched in one pass over the documents; a longer query has a pass of its own.
QUERY_BYTES = 1 << 18


def terms(data: np.ndarray, offsets: np.ndarray):
    """(folded bytes, starts, ends, per-text offsets) of the terms of texts that lie one after the other."""
    data = TERM_BYTES[data]
    return data, *words(data, offsets)


class Terms:
    """The distinct terms of a block of queries, numbered."""

    def __init__(self, texts: list[str | None]):
        number, self.of_query = {}, []
        for _, _, data, offsets in slices(pa.array(texts, pa.string())):
            data, starts, ends, per_text = terms(data, offsets)
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            self.of_query += [sorted({number.setdefault(t, len(number)) for t in found[a:b]}) for a, b in zip(per_text[:-1], per_text[1:])]
        self.bytes = list(number)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """(all terms' bytes one after the other, their offsets)."""
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum([0, *map(len, self.bytes)])


class Finder:
    """Finds the numbered terms among the terms of texts: candidates by hash, each confirmed byte by byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.starts, self.sizes, self.hasher = data, offsets[:-1], np.diff(offsets), SpanHasher()
        hashes = self.hasher(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(places among the spans, term numbers) of the spans that are numbered terms."""
        hashes = self.hasher(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[hits]]
        sizes = ends[hits] - starts[hits]
        hits, number, sizes = (x[sizes == self.sizes[number]] for x in (hits, number, sizes))
        if len(hits):
            same = data[ragged(starts[hits], sizes)] == self.data[ragged(self.starts[number], sizes)]
            sure = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
            hits, number = hits[sure], number[sure]
        return hits, number


def term_counts(docs: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of the documents with a term: all their terms counted in `n`, the numbered ones listed."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        data, offsets = shared.value
        find, width = Finder(data, offsets), len(offsets) - 1
        for batch in batches:
            for lo, hi, text, at in slices(batch.column(1)):
                text, starts, ends, per_text = terms(text, at)
                n = np.diff(per_text)
                hits, number = find(text, starts, ends)
                doc = np.searchsorted(per_text, hits, "right") - 1
                pairs, counts = np.unique(doc * width + number, return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(hi - lo + 1) * width)
                number, counts = (pairs % width).astype("<u4"), counts.astype("<u4")
                kept = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(kept)), pa.array(n[kept], pa.int64()),
                     *(pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in kept], pa.binary()) for x in (number, counts))],
                    names=["id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n long, terms binary, counts binary")


def document_frequencies(counted: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each numbered term; tasks add up before anything is shuffled."""
    def run(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    out = np.zeros(width, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Tree:
    """Balls over the rows of a sparse matrix (offsets, columns, values); rows of a node are a run of `order`."""

    def __init__(self, offsets: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        self.offsets, self.columns, self.values, self.width = offsets, columns, values, width
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.squares = np.bincount(self.row, values * values, len(offsets) - 1)
        self.order = np.arange(len(offsets) - 1)
        self.runs, self.children, centroids, radii = [(0, len(self.order))], [], [], []
        for a, b in self.runs:  # grows as nodes are split
            rows = self.order[a:b]
            at = ragged(offsets[rows], offsets[rows + 1] - offsets[rows])
            centroid = np.bincount(columns[at], values[at], width) / (b - a)
            far = self.distances(rows, centroid)
            centroids.append(centroid)
            radii.append(math.sqrt(far.max()))
            if b - a <= leaf or radii[-1] == 0:
                self.children.append(None)
                continue
            left = rows[far.argmax()]
            to_left = self.distances(rows, self.dense(left))
            halves = np.argsort(to_left - self.distances(rows, self.dense(rows[to_left.argmax()])), kind="stable")
            self.order[a:b] = rows[halves]
            middle = (a + b) // 2
            self.children.append((len(self.runs), len(self.runs) + 1))
            self.runs += [(a, middle), (middle, b)]
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.columns[self.offsets[row]:self.offsets[row + 1]]] = self.values[self.offsets[row]:self.offsets[row + 1]]
        return out

    def distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances, never too small: what rounding can take off is added."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        at = ragged(self.offsets[rows], sizes)
        inner = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.values[at] * point[self.columns[at]], len(rows))
        length = point @ point
        return np.maximum(0, self.squares[rows] + length - 2 * inner) + SLACK * (self.squares[rows] + length)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): no row of the node has a larger inner product."""
        reach = np.sqrt((queries * queries).sum(1))[:, None] * self.radii
        return (queries @ self.centroids.T + reach) * (1 + SLACK) + 1

    def scores(self, node: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores of each query) of a leaf."""
        a, b = self.runs[node]
        rows = self.order[a:b]
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        at = ragged(self.offsets[rows], sizes)
        used, column = np.unique(self.columns[at], return_inverse=True)
        out = np.zeros((len(queries), len(rows)), np.int64)
        local = np.repeat(np.arange(len(rows)), sizes)
        top = max(1.0, queries.max(initial=0)) * max(1.0, self.values[at].max(initial=0))
        step = max(1, min(int(2.0 ** 53 / top), CELLS // len(rows)))  # sums of so many products are exact in doubles
        for lo in range(0, len(used), step):
            part = (column >= lo) & (column < lo + step)
            matrix = np.zeros((min(step, len(used) - lo), len(rows)))
            matrix[column[part] - lo, local[part]] = self.values[at[part]]
            out += (queries[:, used[lo:lo + step]] @ matrix).astype(np.int64)
        return rows, out

    def search(self, queries: np.ndarray, best: np.ndarray):
        """Yields (query, row, score) arrays that hold each query's best rows.

        `best` has the k highest scores a query has met so far, lowest first, and is kept up to date; rows under its lowest
        score are left out, and so are rows that score nothing.
        """
        bounds = self.bounds(queries)
        todo = [(-bounds[:, 0].max(initial=0), 0)]
        while todo:
            _, node = heapq.heappop(todo)
            alive = np.flatnonzero(bounds[:, node] >= np.maximum(best[:, 0], 1))
            if not len(alive):
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    bounds[alive, child] = np.minimum(bounds[alive, child], bounds[alive, node])
                    heapq.heappush(todo, (-bounds[alive, child].max(), child))
                continue
            rows, scores = self.scores(node, queries[alive])
            k = best.shape[1]
            if len(rows) > k:
                top = np.partition(scores, len(rows) - k, axis=1)[:, -k:]
            else:
                top = scores
            best[alive] = np.sort(np.concatenate((best[alive], top), axis=1), axis=1)[:, -k:]
            q, r = np.nonzero(scores >= np.maximum(best[alive, :1], 1))
            yield alive[q], rows[r], scores[q, r]


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)


def impacts_of(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return ((1000000000 * tf) // (1000 * tf + 20 * m)).astype(np.float64)


def search_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str, block_rows: int, leaf: int) -> DataFrame | None:
    """(query, id, score) candidates of a block of queries' texts: each task's best rows of each query, all ties at the end among them."""
    spark, vocabulary = docs.sparkSession, Terms(items)
    width = len(vocabulary.bytes)
    if not width:
        return None
    counted = saved(term_counts(docs, vocabulary.packed(), id_col, text_col), "term_counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = weights_of(n_docs, document_frequencies(counted, width))
    shared = spark.sparkContext.broadcast((vocabulary.of_query, weights))
    block_rows = max(leaf, min(block_rows, CELLS // width * leaf // 2))

    def run(batches):
        of_query, weights = shared.value
        # so many queries at a time that their matrix stays within CELLS
        step = max(1, CELLS // width)
        best = np.zeros((len(of_query), k), np.int64)

        def found(ids, n, numbers, counts):
            sizes = np.array([len(x) // 4 for x in numbers])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            columns = np.frombuffer(b"".join(numbers), "<u4").astype(np.int64)
            tf = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
            tree = Tree(offsets, columns, impacts_of(tf, np.repeat(np.array(n), sizes), n_docs, n_terms), width, leaf)
            for lo in range(0, len(of_query), step):
                queries = np.zeros((min(step, len(of_query) - lo), width))
                for i, own in enumerate(of_query[lo:lo + step]):
                    queries[i, own] = weights[own]
                parts = list(tree.search(queries, best[lo:lo + step]))
                if parts:
                    q, row, score = (np.concatenate(x) for x in zip(*parts))
                    keep = score >= best[lo + q, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lo + q[keep], pa.int32()), ids.take(pa.array(row[keep])), pa.array(score[keep], pa.int64())],
                        names=["query", "id", "score"])

        block = [[], [], [], []]
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                part = batch.slice(a, block_rows)
                block[0].append(part.column(0))
                for own, column in zip(block[1:], part.columns[1:]):
                    own += column.to_pylist()
                held += sum(len(x) // 4 for x in block[2][-part.num_rows:])
                if len(block[1]) >= block_rows or held >= POSTINGS:
                    yield from found(pa.concat_arrays(block[0]), *block[1:])
                    block, held = [[], [], [], []], 0
        if block[1]:
            yield from found(pa.concat_arrays(block[0]), *block[1:])

    kind = counted.schema["id"].dataType.simpleString()
    return counted.mapInArrow(run, f"query int, id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, query_bytes: int = QUERY_BYTES,
           id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank, id, score): the k documents of highest score above 0 for each query, ties to the smaller id.

    Terms are runs of digits, ASCII letters (A-Z folded) and characters beyond ASCII. Queries are a stated set: they are taken in
    blocks of about `query_bytes` of text, one pass over the documents each, and only a block's terms are sent around. A
    null text has no terms; a document without terms is not counted, a query without terms or without hits has no rows.
    Repeated queries are answered each, repeated documents are ranked each, null ids come last among ties and are kept; empty
    tables give no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    texts = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // query_bytes)
    texts = texts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, blocks))))
    item_kind, id_kind = texts.schema["item"].dataType.simpleString(), docs.select(id_col).schema[0].dataType.simpleString()
    ranked = []
    for b in range(blocks):
        own = texts.where(F.col("block") == b).select("item", "text").collect()
        found = search_block(docs, [r["text"] for r in own], k, id_col, text_col, block_rows, leaf) if own else None
        if found is None:
            continue
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        # first among some of a query's candidates, so that no task ranks those of all tasks
        found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        for by in (["query", "salt"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], f"query int, item {item_kind}")
        ranked.append(found.join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
    out = ranked[0] if ranked else spark.createDataFrame([], f"item {item_kind}, rank int, id {id_kind}, score long")
    for more in ranked[1:]:
        out = out.union(more)
    return out.toDF(query_id, "rank", id_col, "score")
