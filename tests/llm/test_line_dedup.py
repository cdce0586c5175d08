import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import line_dedup
from tessera.llm.queries import QUERIES
from tessera.llm.text import utf8, words


def near_lines(a, b):
    """Whether two different lines are within the edits that the shorter one allows:
    one for each EDIT_WORDS words, one at least."""
    k = max(1, min(len(a), len(b)) // line_dedup.EDIT_WORDS)
    if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > k:
        return False
    # an edit changes one word of a line, so no more words can lack a partner
    return sum((Counter(a) - Counter(b)).values()) <= k and distance(a, b) <= k


def distance_up_to_one(a, b):
    if a == b:
        return 0
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    if len(a) < len(b):
        a, b = b, a
    return 1 if len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a))) else 2


def brute(rows):
    return sorted(((*x[:4], ",".join(x[4])) for x in removed(rows)), key=repr)


def removed(rows):
    """doc_id, lines, equal, near and removed lines, by comparing all lines."""
    lines = []
    for r, (k, t) in enumerate(rows):
        for i, x in enumerate((t or "").split("\n")):
            if w := tuple(x.encode().split()):
                lines.append(((k is None, k or 0, i), w, r, i))
    first = {}
    for place, w, _, _ in lines:
        first[w] = min(place, first.get(w, place))
    near = {w for w in first if len(w) >= line_dedup.MIN_WORDS and any(first[x] < first[w] and near_lines(w, x) for x in first)}
    out = [[k, 0, 0, 0, []] for k, _ in rows]
    for place, w, r, i in lines:
        equal = place > first[w]
        out[r][1] += 1
        out[r][2] += equal
        out[r][3] += not equal and w in near
        if equal or w in near:
            out[r][4].append(str(i))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, docs):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[2] for r in want) > 20 and sum(r[3] for r in want) > 0
    assert got(QUERIES["op9_line_dedup"](spark, SF_SMALL)) == want


def test_edits_and_odd_rows(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "cc", "ddd", "é"])
    pool = [[word() for _ in range(rng.randrange(1, 14))] for _ in range(25)] + [["x"] * n for n in range(6, 12)]
    rows = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w[at:at + (kind > 0)] = [word()] if kind < 2 else []
            lines.append(rng.choice([" ", "\t", "  "]).join(w))
        rows.append((rng.choice([None, rng.randrange(100, 200)]), "\n".join(lines), None, None, 0))
    df = odd_docs(spark, rows)
    found = line_dedup.repeated(df)
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert got(found.select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.col("removed").cast("array<string>"), ","))) == want
    kept = line_dedup.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    by_row = [(k, t and "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in r[4])) for (k, t), r in zip(texts, removed(texts))]
    assert got(kept.select("doc_id", "text")) == sorted(by_row, key=repr)


def test_within_one():
    rng = random.Random(8)
    for _ in range(2000):
        a = [rng.randrange(3) for _ in range(rng.randrange(0, 7))]
        b = [rng.randrange(3) for _ in range(rng.randrange(0, 7))] if rng.random() < 0.5 else a[:rng.randrange(0, 7)] + a[rng.randrange(0, 7):]
        assert line_dedup.within_one(np.array(a), np.array(b)) == (distance_up_to_one(tuple(a), tuple(b)) < 2)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[-1] + 1))
    return row[-1]


def test_more_edits_in_longer_lines(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    pool = [[word() for _ in range(n)] for n in (8, 19, 20, 21, 30, 57, 90, 120)] + [["x", "y"] * 15]
    rows = []
    for d in range(100):
        w = list(rng.choice(pool))
        for _ in range(rng.randrange(0, len(w) // 8 + 2)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at:at + (kind > 0)] = [word()] if kind < 2 else []
        rows.append((d, " ".join(w)))
    seen, want = [], {}
    for d, text in rows:
        w = text.split()
        most = lambda v: max(1, min(len(v), len(w)) // 10)
        want[d] = w in seen or any(abs(len(v) - len(w)) <= most(v) and distance(v, w) <= most(v) for v in seen if min(len(v), len(w)) >= 8)
        seen.append(w)
    found = {r.doc_id: bool(r.removed) for r in line_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want and sum(want.values()) > 20 and not all(list(want.values())[20:])


def test_within():
    rng = random.Random(10)
    for _ in range(2000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        k = rng.randrange(0, 6)
        assert line_dedup.within(np.array(a, int), np.array(b, int), k) == (distance(a, b) <= k)


def test_near_lines_share_a_segment():
    """Every pair within the allowed edits has a common key, with many words, few, or one; and parity maps allow it."""
    rng = random.Random(12)
    shared = 0
    for trial in range(400):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 50, 5000]))]
        a = rng.choices(vocabulary, k=rng.choice([20, 21, 29, 30, 55, 140]))
        b = list(a)
        for _ in range(rng.randrange(1, len(a) // 10 + 1)):
            at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[at:at + (kind > 0)] = [rng.choice(vocabulary + ["new"])] if kind < 2 else []
        k = min(len(a), len(b)) // 10
        if a == b or distance(a, b) > k or len(b) < 20:
            continue
        data, offsets = utf8(pa.array([" ".join(a) + "\n" + " ".join(b)]))
        w = words(data, offsets)
        _, head, tail, _, _ = line_dedup.lines_of(w, w.data)
        line, key = line_dedup._segments(w, head, tail)
        assert set(key[line == 0]) & set(key[line == 1])
        _, bits = line_dedup._parities(w, head, tail)
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= 2 * k
        shared += 1
    assert shared > 150


def test_empty_table(spark, docs):
    assert line_dedup.repeated(docs.where(F.lit(False))).count() == 0


def test_near_lines_have_as_many_counted_keys_in_common_as_they_need():
    rng = random.Random(13)
    seen = left_out = 0
    for trial in range(600):
        vocabulary = ["".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(rng.choice([1, 3, 8, 50, 5000]))]
        a = rng.choices(vocabulary, k=rng.choice([8, 9, 15, 19, 20, 21, 29, 30, 55, 140]))
        b = list(a)
        for _ in range(rng.randrange(1, max(1, len(a) // 10) + 1)):
            at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[at:at + (kind > 0)] = [rng.choice(vocabulary + ["new"])] if kind < 2 else []
        if a == b or not near_lines(a, b):
            continue
        data, offsets = utf8(pa.array([" ".join(a) + "\n" + " ".join(b)]))
        w = words(data, offsets)
        _, head, tail, _, _ = line_dedup.lines_of(w, w.data)
        line, key, lines, need = line_dedup._counted(w, head, tail)
        common = len(set(key[line == 0]) & set(key[line == 1]))
        assert len(set(key[line == 0])) == (line == 0).sum() and lines.tolist() == [0, 1] and common >= max(need)
        seen, left_out = seen + 1, left_out + (max(need) > 0)
    assert seen > 300 and left_out > 200


def test_words_lacking_bound_the_edits():
    rng = random.Random(14)
    pairs = [[[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2)] for _ in range(300)]
    at = [np.concatenate([[0], np.cumsum([len(p[i]) for p in pairs])]) for i in (0, 1)]
    flat = [np.array([x for p in pairs for x in p[i]], np.uint32) for i in (0, 1)]
    want = [max(sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values())) for a, b in pairs]
    assert line_dedup._lacking(flat[0], at[0], flat[1], at[1]).tolist() == want
    assert all(distance(a, b) >= n for (a, b), n in zip(pairs, want))


def test_map_has_all_idents(spark):
    rng = np.random.default_rng(15)
    content = rng.integers(-2 ** 63, 2 ** 63 - 1, 20000)
    held = line_dedup._map(line_dedup._idents(spark.createDataFrame([(int(x),) for x in content], "content long"), 7), 7)
    assert line_dedup._is_in(content.view(np.uint64), held).all()
    others = rng.integers(-2 ** 63, 2 ** 63 - 1, 20000).view(np.uint64)
    assert line_dedup._is_in(others, held).mean() < 0.02
    none = line_dedup._map(line_dedup._idents(spark.createDataFrame([], "content long"), 7), 7)
    assert not line_dedup._is_in(others, none).any()


def test_a_common_passage_makes_no_rows(spark, monkeypatch):
    """Lines with a passage in common that are not near are left out by counts; near ones among them are found."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 11)))
    passage = [word() for _ in range(25)]
    texts = [[word() for _ in range(20)] + passage + [word() for _ in range(15)] for _ in range(1500)]
    for i in range(10):
        texts[1000 + i] = texts[i][:3] + ["other"] + texts[i][4:50] + texts[i][51 + i % 2:]
    most = []
    write = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, *a, **b: (out := write(df, *a, **b), most.append(out.count()))[0])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    gone = [r.doc_id for r in line_dedup.repeated(df).where("n_near > 0").collect()]
    assert sorted(gone) == list(range(1000, 1010))
    assert max(most) <= len(texts)


def test_crowded_near_copies(spark):
    """Copies of one line with few or many edits, more than its first line excludes, in rows of equal and null keys."""
    rng = random.Random(17)
    base = [f"word{rng.randrange(3000)}" for _ in range(64)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 11)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((rng.choice([None, i // 2]), " ".join(w) + "\nshort line\n" + " ".join(w[:9])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.repeated(df).select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.col("removed").cast("array<string>"), ","))
    want = brute(rows)
    assert got(found) == want and len({r[3] for r in want}) > 1
