import re

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.llm import url_rules
from tessera.llm.queries import QUERIES
from tessera.llm.sql import ORACLE


def parts(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return (lower(m.group(1)), m.group(2)) if m else ("", "")


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fit = [(len(h or "") + len(p or ""), len(h or ""), a == "block", (h or "") + (p or ""), a) for h, p, a in rules
           if (host == (h or "") or host.endswith("." + (h or "")) or not h) and path.startswith(p or "")]
    return (host, path, *max(fit)[3:]) if fit else (host, path, None, default)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({ORACLE['op6_url_rules']})").fetchall()
    got = [tuple(r) for r in QUERIES["op6_url_rules"](spark, SF_SMALL).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got) == sorted(want) and {r[4] for r in got} == {"allow", "block"}


def test_precedence_and_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "", "block"),
             ("b.org", "/p", "allow"), ("b.org", "/p", "block"), ("com", "/a//b", "block"), ("com", "/a/", "allow")]
    urls = ["http://x.NET/", "http://net", "http://net/", "http://anet/", "https://example.net/en/1?q#f", "http://a.example.net/en/xyz", "http://a.example.net/en/",
            "http://b.org/pq/r", "http://org?x", "x://y://net/", "no scheme.net/", None, "", "://net/", "http://c.com/a//bc", "http://c.com/a/b", "http://é.net/",
            "http://h.net/" + "a/" * 20000, "http://" + "a." * 5000 + "net/x", "http://x.net/\n?", "http://x.NET/", "http:///net/"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, _h string")
    out = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, action string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert set(out.columns) == {"page_id", "url", "_h", "host", "path", "rule", "verdict"}


def test_empty_tables(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    none = url_rules.fixed_rules(spark).where(F.lit(False))
    assert url_rules.judge(pages.where(F.lit(False)), url_rules.fixed_rules(spark)).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, none, default="block").collect()} == {"block"}
