import zlib
from collections import defaultdict

from llm_samples import ODD, prose
from weir.llm import sharding


def check(rows, n):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    most = max(r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    for k, own in shards.items():
        assert 0 <= k < n and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= 2 * most
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sharding.balanced_shards(docs).collect()
    check(rows, 16)
    want = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_odd_texts_and_one_hot_id(documents):
    rows = ODD + [(42, prose(20, 1))] * 300 + [(100 + i, prose(i, i)) for i in range(40)]
    got = sharding.balanced_shards(documents(rows), 5).collect()
    check(got, 5)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1) for i, t in rows)
    assert sharding.balanced_shards(documents([])).collect() == []
    assert [(r.shard, r.slot) for r in sharding.balanced_shards(documents([(1, None)])).collect()] == [(0, 0)]


def test_only_frame_operations(documents):
    plan = sharding.balanced_shards(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
