import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import decontaminate
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    k = min(decontaminate.SHINGLE, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(docs, items):
    """Best similarity of every document and item with a window of 0.8 or more."""
    low = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")]
    items = [(i, low(t)) for i, t in items if low(t)]
    held = Counter(s for _, w in items for s in set(shingles(w)))
    weight = lambda s: 1 + np.log(len(items) / held.get(s, 1))
    out = {}
    for d, text in docs:
        w = low(text)
        for i, own in items:
            want = shingles(own)
            if not set(want) & set(shingles(w)) and len(own) >= 5:
                continue
            n = min(len(own), len(w))
            for at in range(len(w) - n + 1):
                got = shingles(w[at:at + n])
                if len(own) >= 5 > n:
                    continue
                keys = set(want) | set(got)
                total = sum(max(want[k], got[k]) * weight(k) for k in keys)
                s = sum(min(want[k], got[k]) * weight(k) for k in keys) / total if total else 0
                if s >= decontaminate.SIMILARITY - 1e-9 and s > out.get((d, i), 0):
                    out[d, i] = s
    return out


def got(df):
    return {(r.doc_id, x.item_id): x.similarity for r in df.collect() for x in r.leaks}


def same(a, b):
    return set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_edited_windows_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([20, 40, 41, 60])))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (53, "a b c d e")]
    docs = []
    for d in range(120):
        parts = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            own = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                own[rng.randrange(len(own))] = word()
            parts += [x.upper() if rng.random() < 0.1 else x for x in own[rng.randrange(0, 3):]] + [word() for _ in range(rng.randrange(0, 9))]
        docs.append((d, " ".join(parts)))
    docs += [(500, "x tiny item y"), (501, None), (502, ""), (503, "a b c d e"), (504, "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    expected = brute(docs, items)
    assert len(expected) > 40 and min(expected.values()) < 0.9
    assert same(got(decontaminate.matched(df, spark.createDataFrame(items, "item_id long, text string"))), expected)


def test_several_blocks_of_items(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    one = got(decontaminate.matched(docs, items))
    monkeypatch.setattr(decontaminate, "ITEMS_BYTES", 2000)
    assert set(got(decontaminate.matched(docs, items))) == set(one) and one


def test_similarities_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    stem = [[word() for _ in range(12)] for _ in range(3)]  # several items each hold one
    items = [(i, " ".join(rng.choice(stem) + [word() for _ in range(20)] + rng.choice(stem)[:8])) for i in range(40)] + [(90, " "), (91, None)]
    docs = []
    for d in range(80):
        own = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice([0, 1, 1])):
            own[rng.randrange(len(own))] = word()
        docs.append((d, " ".join([word()] * rng.randrange(3) + own[rng.randrange(4):] + rng.choice(stem))))
    expected = brute(docs, items)
    assert len(expected) > 20 and min(expected.values()) < 0.9
    df, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 500):
        monkeypatch.setattr(decontaminate, "ITEMS_BYTES", size)
        assert same(got(decontaminate.matched(df, wanted)), expected)


def test_planted_passages_are_found(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts = docs.select("doc_id", "text").collect()
    exact = {(d, i) for d, t in texts for i, x in items if x in (t or "")}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op8_benchmark_leaks"](spark, SF_SMALL).collect()}
    assert exact and exact <= found


def test_the_radius_covers_the_similarity():
    """Windows of similarity 0.8 or more lie within the radius."""
    rng = np.random.default_rng(5)
    missed = total = 0
    for _ in range(3000):
        n = int(rng.integers(10, 120))
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        other = own.copy()
        change = rng.integers(0, n, max(1, n // 9))
        other[change] = rng.integers(0, 1 << 63, len(change)).astype(np.uint64)
        a, b = (decontaminate.simhash(decontaminate.shingle_bits(x).astype(float).sum(axis=0)[None, :]) for x in (own, other))
        if len(np.intersect1d(own, other)) >= 0.8 * len(np.union1d(own, other)):
            total += 1
            missed += int(np.bitwise_count(a ^ b).sum()) > decontaminate.RADIUS
    assert total > 1000 and missed <= total / 500


def test_odd_rows(spark, docs):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    df = odd_docs(spark)
    out = decontaminate.matched(df, items)
    assert out.columns == [*df.columns, "leaks"] and out.count() == 7 and not got(out)
    assert decontaminate.matched(docs.where(F.lit(False)), items).count() == 0
    assert not got(decontaminate.matched(docs, items.where(F.lit(False))))
