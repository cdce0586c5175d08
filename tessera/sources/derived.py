"""Listings derived from the given tables.

A listing is ``(folder_path STRING, name STRING, size BIGINT)``: one row
per file. These derivations turn the TPC-H-ish tables into file trees with
the shapes the catalog works on (complete and incomplete FASTQ runs, messy
names, a document corpus and two versions of it). Incomplete runs lack one
file of a pair, and each corpus version lacks a tenth of the documents: that
is what the change queries work on. All other corpus queries use ``docs_all``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def _s(c):
    return F.col(c).cast("string")


def runs_listing(t: Tables) -> DataFrame:
    """Paired-read FASTQ names, one pair per (order, line); every seventh
    pair lacks its R2 file."""
    li = (t.lineitem.groupBy("l_orderkey", "l_linenumber")
          .agg(F.min("l_quantity").alias("q")))
    li = li.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("rd"))
    li = li.where(~((F.col("rd") == 2) & (((F.col("l_orderkey") + F.col("l_linenumber")) % 7) == 0)))
    k = F.col("l_orderkey")
    return li.select(
        F.concat(F.lit("/data/run_"), F.lpad((k % 16).cast("string"), 2, "0")).alias("folder_path"),
        F.concat(F.lit("sample"), _s("l_orderkey"), F.lit("_S"), (k % 96).cast("string"),
                 F.lit("_L"), F.lpad(_s("l_linenumber"), 3, "0"), F.lit("_R"), _s("rd"),
                 F.lit("_001.fastq.gz")).alias("name"),
        (F.floor("q").cast("bigint") * 100 + F.col("rd")).alias("size"),
    )


def messy_listing(t: Tables) -> DataFrame:
    """FASTQ-like names with missing parts, odd separators and CSV files."""
    o = t.orders.select("o_orderkey")
    base = o.select(F.floor(F.col("o_orderkey") / 7).cast("bigint").alias("k"),
                    (F.col("o_orderkey") % 7).alias("m"))
    extra = (o.where(F.col("o_orderkey") % 35 == 0)
             .select(F.floor(F.col("o_orderkey") / 7).cast("bigint").alias("k"),
                     F.lit(7).cast("bigint").alias("m")))
    u = base.unionByName(extra)
    k, ks, s9 = F.col("k"), _s("k"), (F.col("k") % 9).cast("string")
    name = (F.when(F.col("m") == 0, F.concat(F.lit("sample"), ks, F.lit("_S"), s9, F.lit("_L001_R1_001.fastq.gz")))
            .when(F.col("m") == 1, F.concat(F.lit("sample"), ks, F.lit("_S"), s9, F.lit("_L001_R2_001.fastq.gz")))
            .when(F.col("m") == 2, F.concat(F.lit("sample"), ks, F.lit("x_S"), s9, F.lit("_L001_R1.fastq.gz")))
            .when(F.col("m") == 3, F.concat(F.lit("sample"), ks, F.lit("y_S"), s9, F.lit("_L001_R2_001.fastq")))
            .when(F.col("m") == 4, F.concat(F.lit("sample"), ks, F.lit("z_S"), s9, F.lit("_L001_001.fastq.gz")))
            .when(F.col("m") == 5, F.concat(F.lit("__sample"), ks, F.lit("..S"), s9, F.lit("_ L001 R1__001.fastq.gz")))
            .when(F.col("m") == 6, F.concat(F.lit("notes_"), ks, F.lit(".csv.gz")))
            .otherwise(F.concat(F.lit("sample"), ks, F.lit(".S"), s9, F.lit(".L001.R1.001.fastq.gz"))))
    return u.select(F.concat(F.lit("/messy/f"), (k % 4).cast("string")).alias("folder_path"),
                    name.alias("name"), (k % 1000).alias("size"))


def _created(doc_id: str = "doc_id"):
    """Time of a document's file: a fixed function of its id."""
    return (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(mins=(F.col(doc_id) % 500000).cast("int")))


def docs_all(t: Tables) -> DataFrame:
    """Corpus listing with every document."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    folder = (F.when(F.col("doc_id") % 89 == 0, F.concat(F.lit("/corpus/old/"), F.col("lang")))
              .when(F.col("doc_id") % 97 == 0, F.concat(F.lit("/corpus/new/"), F.col("lang")))
              .otherwise(F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))))
    return d.select(folder.alias("folder_path"), F.concat(F.lit("doc_"), _s("doc_id"), F.lit(".txt")).alias("name"),
                    F.col("n_chars").alias("size"), _created().alias("created_time"))


def docs_old(t: Tables) -> DataFrame:
    """Corpus listing as stored in the previous snapshot."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars").where(F.col("doc_id") % 10 != 3)
    folder = (F.when(F.col("doc_id") % 89 == 0, F.concat(F.lit("/corpus/old/"), F.col("lang")))
              .otherwise(F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))))
    return d.select(folder.alias("folder_path"),
                    F.concat(F.lit("doc_"), _s("doc_id"), F.lit(".txt")).alias("name"),
                    F.col("n_chars").alias("size"), _created().alias("created_time"))


def docs_new(t: Tables) -> DataFrame:
    """Corpus listing as found on disk now: some files added, some removed,
    every fifth document one byte longer."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars").where(F.col("doc_id") % 10 != 7)
    folder = (F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("/corpus/new/"), F.col("lang")))
              .otherwise(F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return d.select(folder.alias("folder_path"),
                    F.concat(F.lit("doc_"), _s("doc_id"), F.lit(".txt")).alias("name"),
                    size.alias("size"), _created().alias("created_time"))


def stored_totals(d: DataFrame) -> DataFrame:
    """Folder totals as an earlier run stored them; some are off by one."""
    return (d.groupBy("folder_path")
            .agg((F.sum("size") + F.when(F.length("folder_path") % 3 == 0, 1).otherwise(0)).alias("total_size"),
                 F.count(F.lit(1)).alias("file_count"))
            .withColumnRenamed("folder_path", "path"))


def events_listing(t: Tables) -> DataFrame:
    """One log file per (user, day, event type)."""
    e = t.events.select("user_id", "ts", "event_type")
    g = e.groupBy("user_id", F.dayofmonth("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        F.concat(F.lit("/events/g"), (F.col("user_id") % 8).cast("string")).alias("folder_path"),
        F.concat(F.lit("u"), _s("user_id"), F.lit("_d"), _s("d"), F.lit("_"), F.col("event_type"),
                 F.lit(".log")).alias("name"),
        F.col("n").alias("size"))
