"""URL rules by expression expansion and hash prefixes.

Each URL gives host-suffix and path-prefix expressions. Rules and
expressions meet in an equi-join on the first bytes of a digest; the whole
digest and the rule's path then confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import quoted, set_aside

PREFIX_HEX = 8            # hex digits of the short hash
BROADCAST_RULES = 50_000  # rows; rule texts are cut to their digests before


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)\A(.*/)?", 0)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action``. A rule fits its host and
    all subdomains if the URL's path starts with the rule's path; the rule with
    the longest host and path together wins, then the longer host, then
    ``block``. No rule: ``rule`` is null and ``verdict`` is ``default``.

    A rule is looked up by its host and its path's folder, so URLs are expanded
    only at dots and slashes, and only as deep as the deepest rule: all
    expressions that a rule can equal, however long the URL is. Each different
    (host, path) is judged once; pages then take over its verdict, and a page
    address with very many copies is one row in the expansion.

    Null URLs and those without ``://`` have an empty host and path, which a
    rule with an empty host and path would fit. Repeated rows stay. Columns of
    ``urls`` named like the added ones are replaced; others pass through.
    """
    rules = rules.select(F.coalesce("host", F.lit("")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), "action").distinct()
    folder = _folder(F.col("_path"))
    depth = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("_host", r"\."))).alias("labels"),
                      F.max(F.length(folder) - F.length(F.replace(folder, F.lit("/")))).alias("slashes")).first()
    labels, slashes = depth.labels or 0, depth.slashes or 0
    keyed = rules.select("_host", "_path", "action", F.sha2(F.concat_ws("\n", "_host", folder), 256).alias("_digest"))
    keyed = keyed.withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    if depth.n <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    aside, back = set_aside(urls, "host", "path", "rule", "verdict")
    url = F.col(quoted(url))
    pages = urls.select(*aside, host_of(url).alias("host"), path_of(url).alias("path"))
    one = pages.select("host", "path").distinct()
    # substring_index with a negative count keeps the last labels; a host with fewer is itself
    hosts = F.array_distinct(F.array(F.lit(""), *[F.substring_index("host", ".", -i) for i in range(1, labels + 1)], F.col("host")))
    cut = F.array(F.lit(""), *[F.when(F.length("path") - F.length(F.replace("path", F.lit("/"))) >= i,
                                      F.concat(F.substring_index("path", "/", i), F.lit("/"))) for i in range(1, slashes + 1)])
    expanded = (one.withColumn("_h", F.explode(hosts)).withColumn("_p", F.explode(F.array_compact(cut)))
                .withColumn("_full", F.sha2(F.concat_ws("\n", "_h", "_p"), 256))
                .withColumn("_start", F.substring("_full", 1, PREFIX_HEX)))
    confirmed = expanded.join(keyed, F.col("_start") == F.col("_short")).where(
        (F.col("_full") == F.col("_digest")) & (F.col("_h") == F.col("_host")) & F.startswith("path", F.col("_path")))
    rank = F.struct((F.length("_host") + F.length("_path")).alias("a"), F.length("_host").alias("b"), (F.col("action") == "block").alias("c"))
    best = confirmed.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), "action"), rank).alias("_best"))
    return (pages.join(best, ["host", "path"], "left")
            .select(*back, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict")))


def fixed_rules(spark) -> DataFrame:
    """The rules of the registered query (fixed values)."""
    return spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
                                  ("org", "/fr/", "allow")], "host string, path string, action string")
