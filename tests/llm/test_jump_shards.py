import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import jump_shards
from tessera.llm.queries import QUERIES


def jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 24, 25, 1000):
        assert jump_shards.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_query(spark, docs):
    rows = QUERIES["op4_jump_shards"](spark, SF_SMALL).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 24 for r in rows)


def test_balance(spark):
    n = spark.range(60_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    counts = [r["count"] for r in jump_shards.assign(n, 24).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.15 * min(counts)


def test_odd_rows(spark, docs):
    df = odd_docs(spark)
    out = jump_shards.assign(df, 3, parts=2)
    assert set(out.columns) == set(df.columns) | {"slot", "grown_shard"}
    rows = out.collect()
    assert len(rows) == 7 and len({(r.shard, r.slot) for r in rows}) == 7
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and {r.size for r in rows if r.doc_id in (1, 2)} == {8}
    assert jump_shards.assign(docs.where(F.lit(False)), 3).count() == 0
