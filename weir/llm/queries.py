"""The registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from weir.llm import (ball_tree, best_fit_packing, bpe, collocations, hierarchical_packing, language, lm_scoring, near_duplicates, nearest_neighbours,
                      sharding, substring_dedup, token_output, top_k_search)
from weir.llm.common import scratch, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


#: All pairs that share a shingle, the pairs that are similar enough, and what can be reached over them.
NEAR_SQL = r"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(root, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(root, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON a = t.doc_id"""

TOP_SQL = """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: All documents of which an item's term is part, scored in whole numbers.
RANKED_SQL = r"""WITH texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM texts WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
wanted AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, docs),
scores AS (SELECT item, item_id, row, doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (row), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""

#: All phrases, their cuts, and the candidates around them.
PHRASE_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents WHERE text IS NOT NULL),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(flatten([[w[i:i + k - 1] FOR i IN generate_series(1, len(w) - k + 1)]
    FOR k IN [1, 2, 3, 4]])) AS phrase FROM pieces WHERE len(w) > 0) GROUP BY ALL),
c AS (SELECT * FROM f WHERE len(phrase) > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(generate_series(1, len(phrase) - 1)) AS k FROM c) AS c
    JOIN f AS x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f AS y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ones AS (SELECT lang, f, unnest(flatten([[phrase[i:i + k - 1] FOR i IN generate_series(1, len(phrase) - k + 1)]
    FOR k IN generate_series(2, len(phrase) - 1)])) AS phrase FROM c WHERE len(phrase) > 2),
around AS (SELECT lang, phrase, max(f) AS f FROM inner_ones GROUP BY ALL),
kept AS (SELECT lowest.*, array_to_string(phrase, ' ') AS p FROM lowest LEFT JOIN around USING (lang, phrase)
    WHERE around.f IS NULL OR 100 * around.f < 80 * a)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_language_id")
def _op1(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_lm_scoring")
def _op2(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates", NEAR_SQL)
def _op3(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_output")
def _op4(spark, sf_dir):
    path = scratch(spark, "packed")
    return token_output.digests(token_output.write_packed(table(spark, sf_dir, "documents"), path, vocabulary()))


@query("op5_best_fit_packing")
def _op5(spark, sf_dir):
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op6_sharding")
def _op6(spark, sf_dir):
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


@query("op7_top_k_search", TOP_SQL)
def _op7(spark, sf_dir):
    found = top_k_search.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5, lambda x: np.floor(256 * x))
    return found.withColumn("score", found.score.cast("long"))


@query("op8_substring_dedup")
def _op8(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op9_nearest_neighbours")
def _op9(spark, sf_dir):
    return nearest_neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


@query("op10_bpe")
def _op10(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op11_ranked_search", RANKED_SQL)
def _op11(spark, sf_dir):
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_collocations", PHRASE_SQL)
def _op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_hierarchical_packing")
def _op13(spark, sf_dir):
    return hierarchical_packing.digests(hierarchical_packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
