"""Language identification: held-out accuracy, cases without a language."""

import random
import zlib

import numpy as np

from llm_samples import ODD
from weir.llm import language

WORDS = {
    "en": "the of and to in that was with from this have they which would there", "de": "der die und das nicht mit sich auf für auch werden über können",
    "fr": "les des est dans pour que une avec sur être était leurs où", "es": "los las una por con para está como más pero sus año también",
    "xx": "qorr zzul kwatt jjip vrok hhun"}


def sentence(lang, seed, n=25):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_held_out_accuracy_on_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_families_and_odd_texts(documents):
    rows = [(100 + i, sentence(lang, i), lang) for i, lang in enumerate(list(WORDS) * 30)]
    rows += [(i, t, "en") for i, t in ODD] + [(50, "12 34 !!", "en"), (51, "LES DES EST DANS POUR QUE UNE AVEC", None)]
    got = {}
    for r in language.identify(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i in (1, 2, 3, 50):
        assert [(r.lang_pred, r.score) for r in got[i]] == [("und", 0.0)]
    assert got[51][0].lang_pred == "fr" and len(got[8]) == 2
    right = [got[d][0].lang_pred == lang for d, _, lang in rows if d is not None and d >= 100]
    assert sum(right) >= 0.97 * len(right)


def test_predictions_do_not_see_labels(documents):
    rows = [(i, sentence(lang, i), lang) for i, lang in enumerate(list(WORDS) * 20)]
    model = language.fit(documents(rows))
    a = language.predict(documents(rows), model).select("doc_id", "lang_pred", "score").collect()
    b = language.predict(documents([(d, t, None) for d, t, _ in rows]), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_without_labels_or_rows(documents):
    assert {r.lang_pred for r in language.identify(documents([(1, "some words"), (2, None)])).collect()} == {"und"}
    assert language.identify(documents([])).collect() == []
    one = language.identify(documents([(i, sentence("en", i), "en") for i in range(20)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_svm_separates():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - 2 * x[:, 3] + 0.3 > 0, 1.0, -1.0)
    w, b = language.linear_svm(x, y, cost=50.0, epochs=60)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_sampling_with_null_and_hot_ids(documents):
    """Whatever the ids, every language is learnt, from at most as many rows as asked for."""
    for ids in (lambda i: None, lambda i: 7, lambda i: 7 if i % 2 else 1000 + i):
        rows = [(ids(i), sentence(lang, i), lang) for i, lang in enumerate(["en", "de"] * 60)]
        rows += [(ids(1), sentence("en", 1), "en")] * 200  # copies are drawn once
        for most in (2, 40, 2048):
            model = language.fit(documents(rows), max_documents=most)
            assert model.langs == ["de", "en"]
        got = language.predict(documents(rows), model).filter("text is not null").select("lang", "lang_pred").collect()
        assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert language.fit(documents(rows + [(i, sentence("fr", i), "fr") for i in range(3)]), max_documents=2).langs == ["de", "en"]


def test_clashing_columns_are_replaced(documents):
    from pyspark.sql import functions as F
    rows = [(i, sentence(lang, i), lang) for i, lang in enumerate(list(WORDS) * 10)]
    docs = documents(rows).withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    out = language.predict(docs, language.fit(docs))
    assert sum(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out.collect()) >= 48
