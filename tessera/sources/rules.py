"""Rules as data: one rule set per folder prefix.

A rule set says how to cut a file name into parts (``delimiter``), which
parts make the row key (``row_parts``) and the column key (``col_parts``),
and the expected columns (``header``). A folder uses the rule of its
nearest ancestor prefix (an exact folder match is the nearest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import prefixes_at
from ..session import materialize

RULES_SCHEMA = T.StructType([
    T.StructField("folder_prefix", T.StringType(), False),
    T.StructField("version", T.StringType(), True),
    T.StructField("delimiter", T.ArrayType(T.StringType()), True),
    T.StructField("header", T.ArrayType(T.StringType()), True),
    T.StructField("row_parts", T.ArrayType(T.IntegerType()), True),
    T.StructField("col_parts", T.ArrayType(T.IntegerType()), True),
    T.StructField("min_size", T.LongType(), True),
    T.StructField("max_size", T.LongType(), True),
])

RULE_COLUMNS = [f.name for f in RULES_SCHEMA.fields if f.name != "folder_prefix"]

# Layout of a rule.json file.
RULE_JSON_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("delimiter", T.ArrayType(T.StringType())),
    T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("rowRules", T.StructType([T.StructField("matchParts", T.ArrayType(T.IntegerType()))])),
    T.StructField("columnRules", T.StructType([T.StructField("matchParts", T.ArrayType(T.IntegerType()))])),
    T.StructField("sizeRules", T.StructType([T.StructField("minSize", T.LongType()),
                                             T.StructField("maxSize", T.LongType())])),
])

# The rule sets of the derived listings. FASTQ: cut on "_"
# and ".", row key = parts 0,1,2,4,5,6, column key = part 3 (R1 / R2).
FASTQ_RULE = ("1.0.1", ["_", "."], ["R1", "R2"], [0, 1, 2, 4, 5, 6], [3], 100, 1048576)
EVENTS_RULE = ("1.0.0", ["_", "."], ["click", "error", "purchase", "signup", "view"], [0, 1], [2], 0, 0)
CORPUS_RULE = ("1.0.0", ["_", "."], ["txt"], [1], [2], 0, 0)
# Two broken rule sets: a part used by both keys, and a part used twice.
CONFLICT_ACROSS_RULE = ("0.9.0", ["_", "."], ["txt"], [0, 1], [1], 0, 0)
CONFLICT_WITHIN_RULE = ("0.9.1", ["_", "."], ["txt"], [0, 0], [1], 0, 0)

FIXTURE_RULES = [
    ("/data",) + FASTQ_RULE,
    ("/messy",) + FASTQ_RULE,
    ("/events",) + EVENTS_RULE,
    ("/corpus",) + CORPUS_RULE,
    ("/corpus/old",) + CONFLICT_ACROSS_RULE,
    ("/corpus/new",) + CONFLICT_WITHIN_RULE,
]


def rules_frame(spark: SparkSession, rows=None) -> DataFrame:
    """A rules DataFrame from tuples in ``RULES_SCHEMA`` order."""
    return spark.createDataFrame(FIXTURE_RULES if rows is None else rows, RULES_SCHEMA)


def load_rules_json(spark: SparkSession, paths) -> DataFrame:
    """Read ``rule.json`` files; each file's folder becomes its prefix.

    Missing fields become empty arrays / zero, like a plain JSON decode. A file
    that is not JSON gives a rule that fails the rule check, so its folder is
    rejected. ``paths`` may be a glob such as ``root + '/*/rule.json'``.
    """
    schema = T.StructType([*RULE_JSON_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(paths)
           .select("*", F.col("_metadata.file_path").alias("_file")))
    # the path is percent-encoded, but for "+", which a decoder would read as a space
    decoded = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(F.regexp_replace(decoded, r"^file:(//)?", ""), r"/[^/]*$", "")
    bad = F.col("_corrupt").isNotNull()
    return raw.select(
        folder.alias("folder_prefix"),
        F.when(bad, F.lit(MALFORMED)).otherwise(F.coalesce("version", F.lit(""))).alias("version"),
        F.coalesce("delimiter", F.array().cast("array<string>")).alias("delimiter"),
        F.coalesce("header", F.array().cast("array<string>")).alias("header"),
        F.when(bad, F.array(F.lit(-1))).otherwise(F.coalesce("rowRules.matchParts", F.array().cast("array<int>"))).alias("row_parts"),
        F.coalesce("columnRules.matchParts", F.array().cast("array<int>")).alias("col_parts"),
        F.coalesce("sizeRules.minSize", F.lit(0).cast("bigint")).alias("min_size"),
        F.coalesce("sizeRules.maxSize", F.lit(0).cast("bigint")).alias("max_size"),
    )


MALFORMED = "(malformed)"  # version of a rule whose file is not JSON


@dataclass
class RulePlan:
    """A rules table prepared for attachment to a listing: one row per
    prefix, with ``rule_ok`` and ``rule_hash``. ``depths``, ``max_delimiters``
    and ``max_indexes`` bound the per-name expressions so they unroll into
    generated code instead of per-row lambdas."""
    table: DataFrame
    depths: list[int]
    max_delimiters: int
    max_indexes: int

    def resolve(self, folders: DataFrame) -> DataFrame:
        """The nearest rule of each different ``folder_path``: its prefixes at
        the rule depths are joined to the rules and the longest match stays.
        Folders without a rule drop out."""
        x = folders.select("folder_path").distinct().select(
            "folder_path", F.explode(prefixes_at("folder_path", self.depths)).alias("folder_prefix"))
        nearest = F.max_by(F.struct(*RESOLVED), F.length("folder_prefix"))
        return (x.join(self.table, "folder_prefix").groupBy("folder_path").agg(nearest.alias("_rule"))
                .select("folder_path", "_rule.*"))

    def attach(self, df: DataFrame, folders: DataFrame | None = None) -> DataFrame:
        """``df`` with its folders' rules. Rules are resolved once per folder and
        written, so the work per file is one join with a table whose size Spark
        knows: it broadcasts the folders' rules, and never the files, where they are
        small, and splits a large folder where they are not. ``folders``
        (folder_path): the folders, where they are known already; else they are
        read from ``df``, which should then be a table and not a costly plan."""
        resolved = materialize(self.resolve(df if folders is None else folders), "folder-rules")
        return df.join(resolved, "folder_path")


RESOLVED = ["folder_prefix", *RULE_COLUMNS, "rule_ok", "rule_hash"]


def plan_rules(rules: DataFrame) -> RulePlan:
    """Trailing slashes of prefixes go (``/`` is every folder's ancestor); a
    prefix that several rules name is one rule that fails the rule check. One
    small aggregate gives the bounds of the per-name expressions."""
    r = rules.select(F.regexp_replace("folder_prefix", "/+$", "").alias("folder_prefix"), *RULE_COLUMNS)
    r = r.groupBy("folder_prefix").agg(F.min(F.struct(*RULE_COLUMNS)).alias("_rule"), F.count(F.lit(1)).alias("_n"))
    r = r.select("folder_prefix", "_rule.*", "_n")
    empty_i, empty_s = F.array().cast("array<int>"), F.array().cast("array<string>")
    slashes = F.size(F.split("folder_prefix", "/")) - 1
    st = r.agg(F.array_sort(F.collect_set(slashes + 1)).alias("depths"),
               F.max(F.size(F.coalesce("delimiter", empty_s))).alias("kd"),
               F.max(F.greatest(F.size(F.coalesce("row_parts", empty_i)),
                                F.size(F.coalesce("col_parts", empty_i)))).alias("kp")).first()
    # the whole rule as text: blocks are reused only under an unchanged rule
    table = r.select("folder_prefix", *RULE_COLUMNS, (rule_is_valid() & (F.col("_n") == 1)).alias("rule_ok"),
                     F.sha2(F.to_json(F.struct("folder_prefix", *RULE_COLUMNS)), 256).alias("rule_hash"))
    return RulePlan(table, [int(d) for d in (st["depths"] or [])], int(st["kd"] or 0), int(st["kp"] or 0))


def folder_rules(folders: DataFrame, rules) -> DataFrame:
    """Nearest-ancestor rule (and ``rule_ok``) for each row of ``folders``
    (``folder_path``); folders without a rule are absent."""
    plan = rules if isinstance(rules, RulePlan) else plan_rules(rules)
    return plan.resolve(folders)


def assign_rules(listing: DataFrame, rules) -> DataFrame:
    """Attach each file's nearest folder rule. Files whose folder has no rule
    are dropped; ``plans.build`` reports those folders."""
    plan = rules if isinstance(rules, RulePlan) else plan_rules(rules)
    return plan.attach(listing)


def rule_is_valid(row_parts="row_parts", col_parts="col_parts", delimiter="delimiter"):
    """A rule is valid when no part index is used twice (across or within
    the row and column lists), no index is negative and no delimiter is
    empty."""
    idx = F.concat(F.coalesce(F.col(row_parts), F.array().cast("array<int>")),
                   F.coalesce(F.col(col_parts), F.array().cast("array<int>")))
    no_dupes = F.size(F.array_distinct(idx)) == F.size(idx)
    no_negative = ~F.exists(idx, lambda i: i < 0)
    no_empty_delim = ~F.exists(F.coalesce(F.col(delimiter), F.array().cast("array<string>")),
                               lambda d: d == "")
    return no_dupes & no_negative & no_empty_delim


def rule_conflicts(rules_or_folders: DataFrame) -> DataFrame:
    """Part indexes used more than once, per rule row (needs ``row_parts``,
    ``col_parts``); adds ``valid`` and ``conflict_parts`` (sorted, comma
    separated; empty when valid)."""
    idx = F.concat(F.coalesce("row_parts", F.array().cast("array<int>")),
                   F.coalesce("col_parts", F.array().cast("array<int>")))
    dupes = F.array_sort(F.array_distinct(F.filter(
        idx, lambda i: F.size(F.filter(idx, lambda j: j == i)) > 1)))
    return (rules_or_folders
            .withColumn("valid", rule_is_valid())
            .withColumn("conflict_parts", F.array_join(F.transform(dupes, lambda i: i.cast("string")), ",")))
