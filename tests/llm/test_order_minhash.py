import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import order_minhash
from tessera.llm.components import components
from tessera.llm.queries import QUERIES


def shingles(text):
    w = (text or "").split()
    own = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = {}, []
    for s in own:
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return row[-1]


def brute(rows):
    """Class by the least key; texts of one set of links, by full alignment."""
    texts = sorted({t for _, t in rows if t and t.split()})
    own = {t: shingles(t) for t in texts}
    label = {t: t for t in texts}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    degree = dict.fromkeys(texts, 0)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            n, m = len(own[a]), len(own[b])
            if len(set(own[a]) & set(own[b])) * 1.8 < 0.8 * (n + m):
                continue
            k = lcs(own[a], own[b])
            if k >= 0.8 * (n + m - k):
                degree[a] += 1
                degree[b] += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {t: root(t) for t in texts}, degree


def expected(rows):
    label, degree = brute(rows)
    groups = {}
    for k, t in rows:
        if t in label:
            groups.setdefault(label[t], []).append(k)
    name = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(((k, name[label[t]], len(groups[label[t]])) if t in label else (k, k, 1) for k, t in rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


def test_query_against_full_alignment(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(QUERIES["op2_order_minhash"](spark, SF_SMALL)) == expected(rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at:at + (kind != 1)] = [f"new{rng.randrange(10**9)}"] if kind != 2 else []
    return words


def test_groups_passages_and_odd_rows(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = [(1000 + i, " ".join(edited(rng, base, rng.choice([0, 1, 2])))) for i in range(60)]           # near copies of one base
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(rng.choice([15, 20, 40]))])) for i in range(60)]  # one passage, own rest
    pairs = [[word() for _ in range(rng.choice([6, 30, 200]))] for _ in range(40)]
    rows += [(3000 + 2 * i + j, " ".join(p if not j else edited(rng, p, 1))) for i, p in enumerate(pairs) for j in range(2)]
    rows += [(4000, "a b c"), (4001, "a  b\nc"), (4002, "c b a")]
    odd = odd_docs(spark, [(k, t, None, None, 0) for k, t in rows])
    want = expected([tuple(r) for r in odd.select("doc_id", "text").collect()])
    found = order_minhash.classes(odd)
    assert got(found) == want
    one = order_minhash.one_of_each(odd)
    assert one.columns == odd.columns
    kept = [r.doc_id for r in one.collect()]
    assert sorted(map(repr, kept)) == sorted([repr(k) for k, c, n in want if n == 1 or k == c and n > 1 and k not in (4, None)] + ["4", "None"])


def test_later_levels_and_small_elements(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "SMALL", 2)
    test_groups_passages_and_odd_rows(spark)


def test_chains_of_short_variants(spark):
    """Groups of one template whose variants are linked with the next one only."""
    rows = []
    for g, size in enumerate((13, 17, 22, 31, 50)):
        core = [f"g{g}c{i}" for i in range(size - 2)]
        edge = 1 if size < 30 else size // 14  # so many words differ at an end
        for i in range(150):
            head, tail = [f"g{g}h{(i + 1) // 2}x{k}" for k in range(edge)], [f"g{g}t{i // 2}x{k}" for k in range(edge)]
            rows.append((10000 * g + i * 7919 % 1000, " ".join(head + core[edge - 1:len(core) - edge + 1] + tail)))
    want = expected(rows)
    assert sorted({n for _, _, n in want}) == [150]
    assert got(order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_alignment_is_exact_above_the_limit():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randrange(5, 60))]
        b = edited(rng, a, rng.randrange(0, 3))
        ids = {}
        hashed = [np.array([ids.setdefault(x, len(ids) + 1) for x in w], np.uint64) for w in (a, b)]
        x, y = (order_minhash.labelled(h) for h in hashed)
        k = lcs(x.tolist(), y.tolist())
        true = k / (len(x) + len(y) - k)
        s = order_minhash.similarity(x, y)
        assert s == true if true >= 0.8 else s < 0.8


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 102), (102, 101), (7, 7), (200, 201), (201, 200)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    assert order_minhash.classes(none).count() == 0 and order_minhash.one_of_each(none).count() == 0


def test_crowded_shingles_need_exact_counts(spark, monkeypatch):
    """Passages of a sample come last, and any shingle that several texts still have first is crowded."""
    for name, value in (("CROWD", 1), ("RARE", 2), ("SAMPLED", 2)):
        monkeypatch.setattr(order_minhash, name, value)
    test_groups_passages_and_odd_rows(spark)


def test_common_shingles_come_last(spark):
    own = [[bytearray(b"a"), bytearray(b"a"), list(range(1, 11))], [bytearray(b"b"), bytearray(b"b"), [3, 20]], [bytearray(b"c"), bytearray(b"c"), [7]]]
    every = spark.createDataFrame(own, "node binary, label binary, own array<long>")
    found = sorted((bytes(r.node).decode(), r.key) for r in order_minhash._prefixes(every, np.array([1, 2, 3])).collect())
    assert found == [("a", 4), ("a", 5), ("a", 6), ("b", 20), ("c", 7)]


def test_leaders_of_crowded_elements(spark):
    """200 unlinked texts that share ten elements: one row per element joins them, and
    a pair that meets in every element is one candidate."""
    rng = random.Random(5)
    size = {bytes([i]) * 16: rng.choice([90, 100, 130]) for i in range(200)}
    label = {x: x if i % 10 else b"l" * 16 for i, x in enumerate(size)}
    rows = [(key, x, n, i * 7 % 50, label[x]) for key in range(10) for i, (x, n) in enumerate(size.items()) if key < 9 or i % 3]
    buckets = spark.createDataFrame(rows, "key long, node binary, n long, doc long, label binary")
    lead = order_minhash._leaders(buckets, 16).collect()
    assert sorted(r.key for r in lead) == list(range(10))
    want = set()
    for r in lead:
        assert 1 < len(r.leaders) <= 16
        for x in r.leaders:
            for key, y, n, _, own in rows:
                if key == r.key and y != x.node and own != x.label and min(n, x.n) >= order_minhash.SIMILARITY * max(n, x.n):
                    want.add(tuple(sorted((bytes(x.node), y))))
    found = [(bytes(r.a), bytes(r.b)) for r in order_minhash._stars(buckets, 16).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    first = {r.key: bytes(r.leaders[0].node) for r in order_minhash._leaders(buckets, 1).collect()}
    for key in range(10):
        assert first[key] == min((doc, x) for k, x, _, doc, _ in rows if k == key)[1]


def test_maps_keep_links_and_exclude_a_common_passage(spark):
    """60 texts about one passage in one element: pairs that the parity maps exclude never
    become candidates, and every linked pair does, among all pairs and with leaders."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    for passage, rest, size in ((60, 60, order_minhash.BITS), (400, 300, order_minhash.LONG)):
        common = [word() for _ in range(passage)]
        bases = [common + [word() for _ in range(rest)] for _ in range(15)]
        texts = {bytes([i]) * 16: " ".join(edited(rng, bases[i % 15], i // 15 * rest // 100)) for i in range(60)}
        own = {x: order_minhash.labelled(order_minhash.words(*order_minhash.utf8(order_minhash.pa.array([t]))).hash) for x, t in texts.items()}
        linked = {(x, y) for x in own for y in own if x < y and order_minhash.similarity(own[x], own[y]) >= order_minhash.SIMILARITY}
        maps = order_minhash.maps(spark.createDataFrame(list(texts.items()), "node binary, text string"), size)
        buckets = spark.createDataFrame([(1, x, len(own[x]), i, x) for i, x in enumerate(own)], "key long, node binary, n long, doc long, label binary").join(maps, "node")
        pairs = {(bytes(r.a), bytes(r.b)) for r in order_minhash._pairs(buckets, 1, size).collect()}
        assert len(linked) > 40 and linked <= pairs and len(pairs) < 1.2 * len(linked) < 60 * 59 / 4
        if size == order_minhash.BITS:
            lead = {bytes(x.node) for r in order_minhash._leaders(buckets, 16).collect() for x in r.leaders}
            stars = {(bytes(r.a), bytes(r.b)) for r in order_minhash._stars(buckets, 16).collect()}
            assert {p for p in linked if lead & set(p)} <= stars <= pairs
