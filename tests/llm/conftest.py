import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tessera-tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-test-ckpt-", dir="/tmp"))
    return s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def odd_docs(spark, more=()):
    """Nulls, empty texts, ties, repeated rows and clashing extra columns."""
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 4), (4, "one two three", "en", None, 13),
            (4, "one two three", "en", None, 13), (None, "word " * 30, "en", "b", 150), (None, "word " * 30, "en", "b", 150), *more]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for c in ("size", "shard", "slot", "row", "key", "hash", "start", "block", "in0", "part", "order", "end", "host", "words", "lines"):
        df = df.withColumn(c, F.lit("clash"))
    return df
