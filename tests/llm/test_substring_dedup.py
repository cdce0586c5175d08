import hashlib
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import substring_dedup
from tessera.llm.queries import QUERIES


def brute(rows):
    first = {}
    words = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in words:
        if k is not None:
            for i in range(len(w) - 12):
                x = tuple(w[i:i + 13])
                first[x] = min(first.get(x, k), k)
    out = []
    for k, w in words:
        bad = set()
        for i in range(len(w) - 12):
            if k is not None and first[tuple(w[i:i + 13])] < k:
                bad.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in bad).decode()
        out.append((k, len(w), len(bad), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, docs):
    rows = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[2] for r in rows) > 100
    assert got(QUERIES["op1_substring_dedup"](spark, SF_SMALL)) == sorted(
        ((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=repr)


def hard(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 3)
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(8)] + [["a"] * 30]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 3)
            parts += [word() for _ in range(rng.randrange(0, 6))] + p[a:len(p) - rng.randrange(0, 3)]
        rows.append((rng.randrange(100, 220), rng.choice([" ", "\n", "\t "]).join(parts), None, None, 0))
    return odd_docs(spark, [*rows, (-5, " ".join(passages[4]), None, None, 0), (2**62, " ".join(passages[4]), None, None, 0)])


def test_hard_cases(spark):
    df = hard(spark)
    assert got(substring_dedup.deduplicated(df)) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", 3)
    test_hard_cases(spark)


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 15))] for _ in range(4)]
        automaton = substring_dedup.Automaton()
        for t in texts[1:]:
            automaton.add(t)
        held = {tuple(t[i:j]) for t in texts[1:] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = texts[0]
        want = [max([0, *(n for n in range(1, i + 2) if tuple(q[i + 1 - n:i + 1]) in held)]) for i in range(len(q))]
        assert automaton.statistics(q) == want


def test_empty_table(spark, docs):
    assert substring_dedup.deduplicated(docs.where(F.lit(False))).count() == 0
