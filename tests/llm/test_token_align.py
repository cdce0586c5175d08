import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import token_align
from tessera.llm.queries import QUERIES, TOKENIZERS

ODD = ["", None, "  ", " a  b ", "▁ x", "a▁ b", "<|endoftext|> <s> </s> <unk>", "x\n\n  y\t z ", "  q 　 r", "é à b", "日本語 テスト 🙂 ok",
       "a" * 5000, " " * 3000, "word  next", "don't  we'll 12 345", "<0x0A> hi", "\x00 a\x1c b", "Ġ tab\tĊ"]


@pytest.fixture(scope="module")
def files():
    return token_align.Files.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def walked(files, rows):
    """Whole texts by the libraries themselves, and a walk over both lists of ends."""
    import sentencepiece
    from tokenizers import Tokenizer
    one = Tokenizer.from_str(files.a)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_proto=files.b)
    both = token_align.Both(files)
    out = []
    for key, text in rows:
        raw = (" " + (text or "")).encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        size_a, size_b = [[len(of.entries[i]) for i in ids] for of, ids in ((both.of_a, a), (both.of_b, b))]
        if not text or not b"".join(both.of_a.entries[i] for i in a) == raw == b"".join(both.of_b.entries[i] for i in b):
            out.append((key, 0, 0, 0, 0, "", Counter()))
            continue
        links, groups, i, j, end_a, end_b = Counter(), [([], [])], -1, -1, 0, 0
        while end_a < len(raw) or end_b < len(raw):
            met, more_a, more_b = end_a == end_b, end_a <= end_b, end_b <= end_a
            if met and i >= 0:
                groups.append(([], []))
            if more_a:
                i, end_a = i + 1, end_a + size_a[i + 1]
                groups[-1][0].append(a[i])
            if more_b:
                j, end_b = j + 1, end_b + size_b[j + 1]
                groups[-1][1].append(b[j])
            links[a[i], b[j]] += 1
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((key, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), links))
    held = Counter(p for r in out for p in r[-1])
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(*r[:5], sum(k for p, k in r[-1].items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in r[-1].items()), r[5]) for r in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_whole_texts(spark, docs, files):
    want = walked(files, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[4] for r in want) > 10_000 and any(r[5] < r[4] for r in want)
    assert ordered(QUERIES["op12_token_align"](spark, SF_SMALL).collect()) == ordered(want)


def test_odd_texts(spark, files):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(t or "" for t in ODD[:8])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(token_align.aligned(df, files).collect()) == ordered(walked(files, rows))


def test_many_blocks(spark, docs, files, monkeypatch):
    """Counts don't depend on what shares a block, nor on what a task remembers."""
    some = docs.select("doc_id", "text").limit(60)
    want = ordered(walked(files, [tuple(r) for r in some.collect()]))
    monkeypatch.setattr(token_align, "BLOCK", 3000)
    monkeypatch.setattr(token_align, "KNOWN", 500)
    assert ordered(token_align.aligned(some, files).collect()) == want


def test_clashing_columns_and_empty_table(spark, files):
    df = odd_docs(spark).withColumn("n_a", F.lit("clash")).withColumn("pair", F.lit("clash")).withColumn("of", F.lit("clash"))
    rows = token_align.aligned(df, files).collect()
    assert len(rows) == 7 and rows[0].pair == "clash" and rows[0].of == "clash" and rows[0].block == "clash"
    by = {r.doc_id: r for r in rows}
    assert by[1].n_a == by[2].n_a == 0 and by[1].groups_sha256 == "" and by[4].n_a == 3 and by[None].n_a == 31
    assert token_align.aligned(df.where(F.lit(False)), files).count() == 0


def test_gallop():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (10, 10_000), (5000, 5000), (3000, 100_000)):
        other = np.unique(rng.integers(0, 10 ** 6, m))
        drive = np.unique(rng.integers(0, 10 ** 6, n))
        assert (token_align.gallop(drive, other) == np.searchsorted(other, drive)).all()
