import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import line_quality
from tessera.llm.queries import QUERIES
from tessera.llm.sql import ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    return tuple(WORD.findall(low))


def brute(rows, limit=line_quality.LIMIT):
    """(doc_id, source, text) -> rows as the query returns them."""
    seen = defaultdict(set)
    for _, source, text in rows:
        for x in (text or "").split("\n"):
            if WORD.search(x):
                seen[source, normal(x)].add(text)
    common = {k for k, texts in seen.items() if len(texts) > limit}
    out = []
    for doc_id, source, text in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        gone = [normal(x) for x in lines if (source, normal(x)) in common]
        lost = sum(map(len, gone))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        left = len(w) - lost
        depleted = left < line_quality.LEFT_WORDS or 100 * left < line_quality.KEPT_PERCENT * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
                    failed, len(set(gone)), lost, not failed and not depleted))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, docs):
    assert got(QUERIES["op3_line_quality"](spark, SF_SMALL)) == brute([tuple(r) for r in docs.select("doc_id", "source", "text").collect()])


def test_common_lines_and_odd_rows(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: " ".join(f"w{name(i)}x{name(j)}" for j in range(40))
    own = [(100 + i, f"{body(i)}\nSee 12 Rules here\n{body(i + 500)}\nsee  34 rules HERE", "en", "a", 1) for i in range(25)]
    own += [(200 + i, "\n".join(" ".join(f"boiler{name(k)} line{name(j)}" for j in range(15)) + f"\n{body(700 + 10 * i + k)[:20]}" for k in range(5)), "en", "a", 1)
            for i in range(25)]
    copies = [(300 + i, f"{body(999)}\n{body(998)}", "en", "a", 1) for i in range(30)]
    df = odd_docs(spark, [*own, *copies])
    result = line_quality.judge(df)
    names = ["doc_id", *line_quality.COUNTS, "base_failed", "n_common_lines", "common_words", "kept"]
    expected = brute([tuple(r) for r in df.select("doc_id", "source", "text").collect()])
    assert got(result.select(names)) == expected
    kept = {r[0]: r[-1] for r in expected}
    assert all(kept[300 + i] for i in range(30)) and all(kept[100 + i] for i in range(25)) and not any(kept[200 + i] for i in range(25))
    cut = {r.doc_id: r.text for r in line_quality.judge(df, cut=True).collect()}
    assert cut[100] == f"{body(0)}\n{body(500)}\n" and cut[300] == f"{body(999)}\n{body(998)}" and cut[1] is None


def test_lines_with_fixed_neighbours(spark):
    """A footer of three lines goes, and a line that one copied document holds most
    often; exact copies of one text stay. Edited copies are different documents."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: " ".join(f"w{name(i)}x{name(j)}" for j in range(60))
    footer = "all rights reserved\nterms of use\nback to top"
    rows = [(i, f"{body(i)}\n{footer}", "a") for i in range(30)]
    rows += [(100 + i, f"{body(100 + i)}\nread more here\n{body(200 + i)}", "b") for i in range(25)]
    rows += [(300 + i, f"{body(300)}\nread more here\n{body(301)}", "b") for i in range(26)]
    rows += [(400 + i, f"{body(400)}\n{body(401)}\n{body(402)} last{name(i)}", "c") for i in range(20)]
    rows += [(500 + i, f"{body(500)}\n{body(501)}\n{body(502)} last{name(i)}", "c") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_quality.judge(df, cut=True).collect()}
    assert all(r.kept for i, r in out.items())
    assert all(out[i].n_common_lines == 3 and out[i].text == body(i) + "\n" for i in range(30))
    assert all(out[i].n_common_lines == 1 for k in (100, 300) for i in range(k, k + 25))
    assert all(out[400 + i].n_common_lines == 0 for i in range(20)) and all(out[500 + i].n_common_lines == 2 for i in range(21))
    names = ["doc_id", *line_quality.COUNTS, "base_failed", "n_common_lines", "common_words", "kept"]
    assert got(line_quality.judge(df).select(names)) == brute([(i, s, t) for i, t, s in rows])


def test_pages_of_almost_only_boilerplate(spark):
    """60 pages of one host with 150 words of menu and 8 of their own are rejected,
    by the operator, by brute force and by SQL; rules that count groups of near
    copies, or look at neighbours, would keep them."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    menu = "\n".join(" ".join(f"menu{name(k)}item{name(j)}" for j in range(50)) for k in range(3))
    rows = [(i, menu + "\n" + " ".join(f"own{name(i)}x{name(j)}" for j in range(8)), "a") for i in range(60)]
    rows += [(100 + i, menu, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["doc_id", *line_quality.COUNTS, "base_failed", "n_common_lines", "common_words", "kept"]
    found = got(line_quality.judge(df).select(names))
    assert found == brute([(i, s, t) for i, t, s in rows])
    assert all((r[-3], r[-1]) == ((3, False) if r[0] < 100 else (0, True)) for r in found)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(f"select {', '.join(names)} from ({ORACLE['op3_line_quality']})").fetchall(), key=repr) == found


def test_empty_table(spark, docs):
    assert line_quality.judge(docs.where(F.lit(False))).count() == 0
