import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import neighbour_votes
from tessera.llm.queries import QUERIES
from tessera.llm.text import words

SF_LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_LARGER}/labels.parquet").collect()}
    rows = QUERIES["op11_neighbour_votes"](spark, SF_LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{SF_LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in own if y == k] for k in (1, 0))
    assert len(own) > 50 and len(bad) > 5
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.6


def test_labels_of_held_out_documents_are_not_used(spark, docs):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(neighbour_votes.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (neighbour_votes.score(docs, neighbour_votes.fit(docs, x)).select("doc_id", "score").toPandas().sort_values("doc_id") for x in (labels, turned))
    assert np.allclose(one.score, two.score)


def test_scores_against_all_pairs(spark, docs):
    """Votes from cosines taken pair by pair, over the space's own vectors."""
    space = neighbour_votes.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rows = docs.where("length(text) > 0").select("text").limit(40).toPandas().text.tolist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in neighbour_votes.score(df, space).collect()}
    for i, text in enumerate(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        t = neighbour_votes.terms(words(data, np.array([0, len(data)]), neighbour_votes.lower()))
        dense = np.zeros(neighbour_votes.TERMS)
        dense[t.term] = (1 + np.log(t.count)) * space.idf[t.term]
        for part in (slice(0, neighbour_votes.WORDS), slice(neighbour_votes.WORDS, -neighbour_votes.GAPS), slice(-neighbour_votes.GAPS, None)):
            dense[part] /= max(np.linalg.norm(dense[part]), 1e-12)
        v = dense @ space.matrix
        cosine = [float(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)) for x in space.vectors.astype(float)]
        near = sorted(range(len(cosine)), key=lambda j: -cosine[j])[:neighbour_votes.NEIGHBOURS]
        weight = [max(cosine[j], 0) ** neighbour_votes.SHARPNESS for j in near]
        assert abs(got[i] - sum(a * space.labels[j] for a, j in zip(weight, near)) / sum(weight)) < 1e-3


def test_odd_rows(spark, docs):
    df = odd_docs(spark).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash")).withColumn("term", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (4, 1, "x"), (None, 1, "x"), (9, 1, "x"), (2, None, "x"), (1, 7, "x")],
                                   "doc_id long, quality int, text string")
    space = neighbour_votes.fit(df, labels)
    rows = neighbour_votes.score(df, space).collect()
    assert len(rows) == 7 and rows[0].label == "clash" and "text" not in rows[0].asDict()
    assert all(r.score == space.prior for r in rows if r.doc_id in (1, 2, 3))
    assert not any(r.held_out for r in rows if r.doc_id is None)
    none = neighbour_votes.fit(df, labels.where(F.lit(False)))
    assert {r.score for r in neighbour_votes.score(df, none).collect()} == {0.5}
    assert neighbour_votes.score(df.where(F.lit(False)), neighbour_votes.fit(df.where(F.lit(False)), labels)).count() == 0
