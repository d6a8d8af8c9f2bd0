"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

A text is lower-cased, its bytes that are not letters become spaces, and its byte 1- to 3-grams are hashed into `BINS`
frequencies. All classifiers are linear in those, so that a text is scored by summing the weights of its grams; the whole text
is read in slices of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.arrays import slices
from weir.llm.common import Shared, bounded_batches, fold, free_name

BINS = 4096
#: Language families by ISO 639-1 code. A label that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"], "celtic": ["ga", "cy", "gd", "br"], "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"], "iranian": ["fa", "ku", "tg", "ps"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"], "semitic": ["ar", "he", "am", "mt"],
    "dravidian": ["ta", "te", "kn", "ml"], "malayic": ["id", "ms", "tl", "jv"],
}
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bins of all grams in text order, gram offsets of the texts); runs of other bytes count as one space."""
    letter = LETTERS[data]
    keep = letter | np.concatenate(([True], letter[:-1])) if len(data) else letter
    count = np.concatenate(([0], np.cumsum(keep)))
    offsets, symbols = count[offsets], np.where(letter, data, 32)[keep].astype(np.uint32)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(symbols))
    padded = np.concatenate((symbols, np.zeros(2, np.uint32)))
    bins = np.full((len(symbols), 3), BINS, np.int32)
    h = np.zeros(len(symbols), np.uint32)
    for n in range(3):
        h = h * np.uint32(0x01000193) + padded[n:n + len(symbols)] + np.uint32(1 + n * 977)
        inside = (at + n < doc_end) & ((symbols != 32) if n == 0 else True)
        bins[inside, n] = ((h * np.uint32(0x9E3779B1)) >> np.uint32(20))[inside]
    return bins, offsets


def lowered(texts: pa.Array):
    """(bytes, offsets) of the texts in lower case."""
    return next((data, offsets) for _, _, data, offsets in slices(pc.utf8_lower(texts), 1 << 62))


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gram frequencies of each text, summing to 1; zero for a text without grams."""
    bins, offsets = grams(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    flat = (doc[:, None] * (BINS + 1) + bins).ravel()
    table = np.bincount(flat, minlength=n * (BINS + 1)).reshape(n, BINS + 1)[:, :BINS].astype(np.float32)
    return table / np.maximum(table.sum(1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 1):
    """Weights and bias of a linear support vector machine by dual coordinate descent; y is -1 or 1, classes weigh the same."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    bound = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2 * cost
    square, w, alpha = np.einsum("ij,ij->i", x, x), np.zeros(x.shape[1]), np.zeros(len(x))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], w[-1]


class Model:
    """Families, and the weights of every classifier as the columns of one table."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(s) for s in self.langs})
        self.scale = np.append(1 / np.sqrt(x.mean(0) + 1e-5), 0) if len(x) else np.zeros(BINS + 1)
        x, own = x * self.scale[:BINS], np.array(langs)
        kin = np.array([family(s) for s in langs])
        columns = []
        for f in self.families if len(self.families) > 1 else []:
            columns.append(linear_svm(x, np.where(kin == f, 1.0, -1.0)))
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family(a) == family(b)]
        for a, b in self.pairs:
            rows = (own == a) | (own == b)
            columns.append(linear_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0)))
        self.weights = np.zeros((BINS + 1, len(columns)))
        for i, (w, _) in enumerate(columns):
            self.weights[:BINS, i] = w
        self.weights *= self.scale[:, None]
        self.bias = np.array([b for _, b in columns])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bins, offsets = grams(data, offsets)
        counts = (bins < BINS).sum(1)
        out = np.zeros((len(offsets) - 1, len(self.bias)))
        total = np.concatenate(([0], np.cumsum(counts)))
        total = np.maximum(total[offsets[1:]] - total[offsets[:-1]], 1)
        for i in range(len(self.bias)):
            w = self.weights[:, i]
            sums = np.concatenate(([0], np.cumsum(w[bins[:, 0]] + w[bins[:, 1]] + w[bins[:, 2]])))
            out[:, i] = (sums[offsets[1:]] - sums[offsets[:-1]]) / total + self.bias[i]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        """(index of the language, score in 0 to 1) of each text."""
        m, n = self.margins(data, offsets), len(offsets) - 1
        several = len(self.families) > 1
        kin = m[:, :len(self.families)].argmax(1) if several else np.zeros(n, int)
        score = 1 / (1 + np.exp(-2 * m[np.arange(n), kin])) if several else np.ones(n)
        base = len(self.families) if several else 0
        votes, least = np.zeros((n, len(self.langs))), np.full((n, len(self.langs)), 30.0)
        for i, (a, b) in enumerate(self.pairs):
            for lang, sign in ((a, 1), (b, -1)):
                k, margin = self.langs.index(lang), sign * m[:, base + i]
                votes[:, k] += (margin >= 0) + 1e-3 * np.tanh(margin)
                least[:, k] = np.minimum(least[:, k], margin)
        of = np.array([self.families.index(family(s)) for s in self.langs])
        best = np.where(of[None] == kin[:, None], votes, -1e9).argmax(1)
        return best, score / (1 + np.exp(-2 * least[np.arange(n), best]))


def fit(labelled: DataFrame, max_documents: int = 2048, text_col: str = "text", lang_col: str = "lang",
        id_col: str = "doc_id") -> Model | None:
    """A model from at most `max_documents` labelled rows, as many of each language, drawn by a hash of id and text.

    The bound keeps the training table at `max_documents` rows of `BINS` numbers. Every language has a row in it; of more than
    `max_documents` languages, those with the most rows are learnt. Rows without a label or a letter are left out; None if there
    are no others. Null and repeated ids are ids like others; of rows equal in id and text one is drawn.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.xxhash64(id_col, text_col, F.lit(17)).alias("_ticket"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    langs = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(max_documents).collect()
    if not langs:
        return None
    quota = max_documents // len(langs)
    first = Window.partitionBy("_lang").orderBy("_ticket")
    # the highest ticket that is drawn of each language, from the tickets alone; each task passes on a quota of each at most
    tickets = rows.select("_lang", "_ticket").filter(F.col("_lang").isin([r["_lang"] for r in langs])).distinct()
    drawn = tickets.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= quota).groupBy("_lang").agg(F.max("_ticket")).collect()
    highest = F.create_map(*[F.lit(x) for r in drawn for x in r])
    some = rows.filter(F.col("_ticket") <= highest[F.col("_lang")]).dropDuplicates(["_lang", "_ticket"])

    def run(batches):
        for batch in batches:
            for lo, hi, *_ in slices(batch.column(0)):
                table = frequencies(*lowered(batch.column(0).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in table])],
                                                 names=["lang", "x"])

    got = some.select("_text", "_lang").mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """Adds `pred_col` and `score_col`. A null text or one without a letter is `und` with score 0, as is every text if there is
    no model. Only the text is looked at; all other columns stay, but those that bear the new names are replaced; rows do not move."""
    bounded_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (pred_col.lower(), score_col.lower())])
    letters, at = free_name("_letters", docs.columns), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            n, model = batch.num_rows, shared.value
            lang, score = np.full(n, "und", object), np.zeros(n)
            texts = batch.column(at)
            if model is not None and n:
                has = batch.column(last).to_numpy(zero_copy_only=False)
                for lo, hi, *_ in slices(texts):
                    best, s = model.predict(*lowered(texts.slice(lo, hi - lo)))
                    lang[lo:hi] = np.array(model.langs, object)[best]
                    score[lo:hi] = s
                lang[~has], score[~has] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(lang, pa.string()), pa.array(score)],
                names=[*batch.schema.names[:last], pred_col, score_col])

    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(letters, has).mapInArrow(run, schema)


def identify(docs: DataFrame, max_documents: int = 2048, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row: learnt from the labelled rows that are not held out (crc32 of the id
    modulo 3 is 1). Nulls, empty texts, ties and repeated rows as in `predict`; an empty table gives no rows."""
    held_out = fold(id_col, 3) == 1
    model = fit(docs.filter(~held_out), max_documents, text_col, lang_col, id_col)
    return predict(docs.select(id_col, held_out.alias("held_out"), text_col), model, text_col).select(
        id_col, "held_out", "lang_pred", "score")
