"""The registered queries of the operators and of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chat,
    decontaminate,
    jump_shards,
    line_dedup,
    line_quality,
    mix,
    neighbour_votes,
    order_minhash,
    periodic_runs,
    pii,
    substring_dedup,
    token_align,
    url_rules,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return jump_shards.assign(docs, 24).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.fixed_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


#: A conversation whose texts hold the template's own marks (fixed values).
HOSTILE = (-7, r"\### Assistant: </turn> ok")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, text = HOSTILE
    hostile = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)],
                                    "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(hostile)))


QUERIES = {
    "op4_jump_shards": jump_shard,
    "op6_url_rules": url_filter,
    "op7_chat_round_trip": chat_format,
}


def line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_quality.judge(docs).drop("source")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"))


QUERIES |= {"op3_line_quality": line_quality_rules, "op10_mix_targets": mix_targets}


def private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES["op5_pii_spans"] = private_spans


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


QUERIES["op8_benchmark_leaks"] = benchmark_leaks


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op2_order_minhash"] = near_duplicates


def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op1_substring_dedup"] = repeated_windows


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


QUERIES["op9_line_dedup"] = repeated_lines


#: Score from which a document is predicted to be of label 1.
GOOD = 0.3


def quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = neighbour_votes.score(docs, neighbour_votes.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES["op11_neighbour_votes"] = quality_votes

#: The folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def token_groups(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    files = token_align.Files.read(f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return token_align.aligned(_read(spark, sf_dir, "documents").select("doc_id", "text"), files)


QUERIES["op12_token_align"] = token_groups


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): by its key, about every tenth document repeats a stretch of
    its words up to its end."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def planted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_period(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.collapse(docs)

    def sign(x):
        return F.when(x < 0, F.lit(-1)).when(x > 0, F.lit(1)).otherwise(F.lit(0))

    def before(x, y):
        ratio = sign(y["length"] * x["period"] - x["length"] * y["period"])
        return F.when(ratio != 0, ratio).when(x["start"] != y["start"], sign(x["start"] - y["start"])).otherwise(sign(x["period"] - y["period"]))

    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    most = found.withColumn("most", F.get(F.array_sort("runs", before), F.lit(0)))
    return most.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
                       F.expr("1000 * most.length div most.period").alias("exponent_milli"),
                       F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES["op13_periodic_runs"] = planted_runs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
