import re

from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import mix
from tessera.llm.queries import QUERIES


def water_filling(sizes):
    """Targets by sharing the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over


def check(rows, texts):
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in texts.items()}
    sizes = {}
    for k, (_, s) in texts.items():
        sizes[s] = sizes.get(s, 0) + words[k]
    want = water_filling(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = texts[r.doc_id][1]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        block = max(1, min(mix.BLOCK_WORDS, sizes[s] // mix.BLOCKS))
        assert abs(taken[s] - want[s]) <= 3 * block + 1


def test_query(spark, docs):
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = QUERIES["op10_mix_targets"](spark, SF_SMALL).collect()
    check(rows, texts)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op10_mix_targets"](spark, SF_SMALL).collect()))


def test_draws_are_disjoint_blocks_in_equal_shards(spark, docs):
    mixed = mix.mix(docs, shards=5)
    draws = mixed.select("source", F.explode("draws").alias("d")).select("source", "d.*").collect()
    blocks = {}
    for d in draws:
        blocks.setdefault(d.shard, set()).add((d.source, d.position))
    assert sorted(blocks) == list(range(5)) and max(map(len, blocks.values())) - min(map(len, blocks.values())) <= 1
    assert sum(map(len, blocks.values())) == len(set.union(*blocks.values()))  # no block in two shards
    texts = mix.drawn_texts(mixed)
    assert texts.columns[:-1] == [c for c in mixed.columns if c not in ("text", "draws")]
    n = F.coalesce(F.regexp_count("text", F.lit(mix.WORD)), F.lit(0))
    assert texts.agg(F.sum(n)).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_hypergeometric_draws(spark):
    """Mean and variance, and the bounds of the support."""
    df = spark.range(4000).select(mix.hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(20).cast("long"),
                                                     mix.uniform(F.lit(5), F.col("id"))).alias("x"))
    mean, var, low, high = df.agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
    assert abs(mean - 6) < 0.15 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.3 and 0 <= low and high <= 20
    cases = [(0, 5, 3, 0), (5, 0, 3, 3), (4, 6, 10, 4), (0, 0, 0, 0), (7, 2, 0, 0)]
    rows = spark.createDataFrame(cases, "g long, b long, d long, want long").select(mix.hypergeometric(F.col("g"), F.col("b"), F.col("d"), F.lit(0.999)), "want")
    assert all(a == b for a, b in rows.collect())


def test_permutation(spark):
    for n in (1, 2, 7, 512, 1000):
        df = spark.range(n).select((F.col("id") * mix.permuted(F.lit(0), F.lit(n).cast("long"))) % n)
        assert sorted(r[0] for r in df.collect()) == list(range(n))


def test_odd_rows(spark, docs):
    df = odd_docs(spark, [(50, "x y z " * 200, "en", "a", 0), (51, "p " * 100, "en", "c", 0)])
    out = mix.mix(df)
    assert set(out.columns) == set(df.columns) | {"source_size", "target", "taken", "draws"}
    rows = out.collect()
    assert len(rows) == 9 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.source_size for r in rows if r.source == "a"} == {600} and {r.taken for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mix.mix(docs.where(F.lit(False))).count() == 0
    assert {(r.target, r.taken) for r in mix.mix(docs.withColumn("text", F.lit(" "))).collect()} == {(0.0, 0)}
