"""From documents to packed sequences: language ID, near-duplicates, repeated passages, packing.

Each stage takes all rows its predecessor kept, as a table that was written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.best_fit_packing import pack_documents
from weir.llm.common import fold, free_name, saved, small, table
from weir.llm.language import fit, predict
from weir.llm.near_duplicates import near_duplicates
from weir.llm.substring_dedup import repeated_passages, without_passages

#: SQL has no form of these stages; tests hold them against plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: set[str] | None = None) -> DataFrame:
    """Documents in no language (`und`: no text, or no letter in it) go, and with `languages` those predicted to be in another
    one; the others keep all columns, and a null `lang` is filled with the prediction.

    Without a labelled row there is no model: all documents with a letter stay as they are. Rows of one id, null or not, are
    judged each by their text, which is read whole. Columns may bear any further names.
    """
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    found = predict(docs, model, pred_col=lang, score_col=score).filter(F.col(lang) != "und")
    if languages is not None:
        found = found.filter(F.col(lang).isin(sorted(languages)))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, once if its row is repeated.

    Rows without an id and documents without a word all stay. Columns may bear any further names.
    """
    gone_id, again_id, many = (free_name(c, docs.columns) for c in ("_gone", "_again", "_many"))
    found = near_duplicates(docs)
    gone = small(saved(found.filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone"))
    kept = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    again = small(saved(kept.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(many)).filter(
        F.col(many) > 1).select(F.col("doc_id").alias(again_id)), "again"))
    if not again.limit(1).count():
        return kept
    repeated = kept.join(again, F.col("doc_id") == F.col(again_id), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, F.col("doc_id") == F.col(again_id), "left_anti").unionByName(repeated)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut; documents with nothing else go.

    `n_chars`, if it is there, is counted anew. Rows without an id and null texts stay as they are; whole texts are read. Columns may
    bear any further names.
    """
    out = without_passages(docs, repeated_passages(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as token pieces in sequences of up to 4096 tokens.

    A null or empty text is its end token alone; ids may be null or repeated; columns but `doc_id` and `text` are not read.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
