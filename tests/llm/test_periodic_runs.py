import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import periodic_runs
from tessera.llm.queries import QUERIES
from tessera.llm.text import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(w):
    """(start, length, period) by trying all periods."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def brute(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    runs = runs_of(w)
    most = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *most, 1000 * most[1] // most[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_brute_force(spark, docs):
    want = [brute(r.doc_id, r.text) for r in docs.collect()]
    assert sum(r[1] for r in want) > 20
    assert ordered(QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()) == ordered(want)


def test_random_texts_of_few_words():
    """Texts of one chunk share their grammar; runs don't cross them."""
    rng = random.Random(13)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            a, p = rng.randint(0, n), rng.randint(1, max(1, n // 3))
            texts.append([w[a + (i - a) % p] if i >= a and a + p <= n else w[i] for i in range(n)])
        flat = np.array([x for w in texts for x in w], np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        start, end, period = periodic_runs.find(mix(flat + np.uint64(5)), row)
        want, at = [], 0
        for w in texts:
            want += [(at + s, at + s + length, q) for s, length, q in runs_of(w)]
            at += len(w)
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_nested_runs():
    """A run inside the period of another: both are found, each at all its places."""
    w = (["x"] * 6 + ["a", "b", "c"]) * 5 + ["z"]
    names = {x: i for i, x in enumerate("xabcz")}
    found = periodic_runs.find(mix(np.array([names[x] for x in w], np.uint64)), np.zeros(len(w), np.int64))
    got = [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in found))]
    assert got == runs_of(w) and (0, 45, 9) in got and (36, 6, 1) in got


def test_odd_rows_and_long_texts(spark):
    more = [(10, "a b " * 30_000, "en", "a", 0), (11, " ".join(f"w{i}" for i in range(20_000)), "en", "a", 0), (12, "ü é ü é ü é ü é\nü\té", "en", "a", 0)]
    df = odd_docs(spark, more).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    rows = periodic_runs.collapse(df).collect()
    assert len(rows) == df.count() and "text" not in rows[0].asDict() and rows[0]["size"] == "clash"
    out = {r.doc_id: r for r in rows}
    assert all(out[i].runs == [] and out[i].n_words == 0 and out[i].collapsed == "" for i in (1, 2, 3))
    assert [tuple(r) for r in out[10].runs] == [(0, 60_000, 2)] and out[10].collapsed == "a b"
    assert out[11].runs == [] and out[11].collapsed == more[1][1]
    assert [tuple(r) for r in out[12].runs] == [(0, 10, 2)] and out[12].collapsed == "ü é"
    assert sum(r.doc_id is None and [tuple(x) for x in r.runs] == [(0, 30, 1)] for r in rows) == 2


def test_empty_table(spark, docs):
    assert periodic_runs.collapse(docs.where(F.lit(False))).count() == 0
