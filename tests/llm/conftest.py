import os

import public_tokenizers
import pytest
from pyspark.sql import types as T

from llm_samples import CLASHES

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang]) with clashing extra columns."""
    from pyspark.sql import functions as F

    def make(rows, clashes=True):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.withColumns({c: F.lit(7) for c in CLASHES}) if clashes else df

    return make


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("WEIR_TEST_SF", "/root/testdata/sf0.001")
