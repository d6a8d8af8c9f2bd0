"""The pipeline against plain Python on a small table, and its entry in the registry."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from llm_samples import prose, tokens


def test_stages_on_planted_cases(spark, documents, vocabulary, tmp_path):
    passage = prose(60, 500, 4000)
    rows = [(i, prose(120, i, 4000), "en") for i in range(20)]
    rows += [(30, rows[3][1], "en"), (31, rows[4][1].upper() + " tail", "en"), (32, None, None), (33, "123 !! 4", "en"), (34, "", "en")]
    rows += [(40, prose(80, 41, 4000) + " " + passage, "en"), (41, passage + " " + prose(90, 42, 4000), "en"), (42, "tiny text", "de")]
    rows += [(5, rows[5][1], "en")]  # a repeated row
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library, left = Tokenizer.from_file(vocabulary), {}
    for d, t, _ in rows:
        if tokens(t) and any(c.isalpha() for c in t) and d not in (30, 31):
            left[d] = prose(90, 42, 4000) if d == 41 else t
    want = {}
    for d, t in left.items():
        want[d] = [*library.encode(t, add_special_tokens=False).ids, 1]
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert {r.doc_id: r.ids_crc32 for r in got} == {d: zlib.crc32(np.array(ids, "<u4").tobytes()) for d, ids in want.items()}


def test_stages_keep_the_columns(spark, documents):
    docs = documents([(i, prose(70, i, 4000), "en") for i in range(6)] + [(9, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == (6 if stage is corpus_pipeline.identify_language else 7)
    none = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []


def test_without_labels_documents_with_letters_stay(spark, documents):
    docs = documents([(1, prose(70, 1, 4000)), (2, "e"), (3, "12 !!"), (4, None), (5, "")])
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_any_column_names_go_through_the_stages(spark, documents):
    from pyspark.sql import functions as F
    names = ["score", "lang_pred", "_gone", "_again", "_many", "count", "_cuts", "_cut_id", "_cut", "_letters", "bucket", "places", "doc",
             "passage_start", "passage_end", "_Ticket", "_lang", "_text", "component_id", "kept", "n_shingles", "held_out"]
    passage = prose(60, 500, 4000)
    rows = [(i, prose(90, i, 4000), "en") for i in range(12)] + [(3, prose(90, 3, 4000), "en"), (20, prose(90, 4, 4000), "en"),
            (21, passage + " " + prose(70, 21, 4000), None), (22, passage + " " + prose(70, 22, 4000), "en"), (None, "no id", "en"), (9, None)]
    docs = documents(rows).withColumns({c: F.lit("x") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == "x" for r in got for c in names)
    corpus_pipeline.pack(spark, docs, "").collect()


def test_the_language_stage_decides(spark, documents):
    from test_language import sentence
    rows = [(i, sentence(lang, i), lang) for i, lang in enumerate(["en", "fr"] * 30)] + [(100, sentence("fr", 100), None), (101, sentence("en", 101), None)]
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, documents(rows), "").collect()}
    assert len(out) == len(rows) and out[100] == "fr" and out[101] == "en"
    out = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents(rows), "", {"en"}).collect()}
    assert 100 not in out and 101 in out and len(out) == 31


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
