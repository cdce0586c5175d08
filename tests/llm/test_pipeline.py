import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL, odd_docs
from tessera.llm import jump_shards, line_quality
from test_decontaminate import brute as leaks
from test_jump_shards import jump
from test_line_quality import brute as judged
from test_order_minhash import expected as classes


@pytest.fixture(scope="module")
def stages(spark):
    """The documents after each stage."""
    out, docs = [], spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, docs, stages):
    quality, near, clean, mixed, sharded = stages
    before = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    kept = {r[0] for r in judged(before) if r[-1]}
    after = {r.doc_id: r.text for r in quality.collect()}
    assert set(after) == kept and quality.columns == docs.columns and len(kept) < len(before)
    # at this size no line is common to more documents of a source than the limit
    assert after == {k: t for k, _, t in before if k in kept}

    groups = classes(list(after.items()))
    assert {r.doc_id for r in near.collect()} == {k for k, c, _ in groups if k == c} and near.count() < quality.count()

    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in near.collect()}
    shared = [(k, t) for k, t in texts.items() if any(" ".join(x.split()[3:8]) in t for _, x in items)]
    found = {k for k, _ in leaks(shared, items)}
    assert {r.doc_id for r in clean.collect()} == set(texts) - found and found

    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean.collect()}
    assert set(words) <= set(sizes) and all(n <= 3 * sizes[k] for k, n in words.items())
    assert abs(sum(words.values()) - sum(sizes.values())) <= 0.02 * sum(sizes.values())

    rows = sharded.collect()
    assert len(rows) == mixed.count() and all(0 <= r.shard < corpus_pipeline.SHARDS and r.grown_shard in (r.shard, corpus_pipeline.SHARDS) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {tuple(x) for x in [(r.doc_id, r.shard) for r in rows]} == {(k, s) for k, s in {r.doc_id: r.shard for r in rows}.items()}
    assert jump(5, 24) == jump_shards.jump(__import__("numpy").array([5], "uint64"), 24)[0]


def test_stages_take_odd_rows_and_empty_tables(spark, docs):
    good = " ".join(f"word{i}" for i in range(60))
    for frame in (odd_docs(spark, [(60, good, "en", "a", 0), (61, good + " more", "en", None, 0)]), docs.where(F.lit(False))):
        columns = frame.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.materialize(stage(spark, frame, SF_SMALL), f"test-{name}")
            assert frame.columns == columns, name
        assert corpus_pipeline.sharding(spark, frame, SF_SMALL).count() == frame.count()


def test_common_lines_go_from_kept_documents(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: " ".join(f"w{name(i)}x{name(j)}" for j in range(60))
    rows = [(i, f"{body(2 * i)}\nAll rights reserved.\n{body(2 * i + 1)}", "en", "a", 0) for i in range(line_quality.LIMIT + 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality(spark, df, SF_SMALL).collect()}
    assert out == {i: (t.replace("All rights reserved.\n", ""), len(t) - 21) for i, t, *_ in rows}
