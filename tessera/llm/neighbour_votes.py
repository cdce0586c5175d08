"""Quality scores by the votes of nearest neighbours in a latent-semantic space.

Texts are weighted by terms: their words, the shapes of their words (``a``
for letters, ``0`` for digits, all else as it is, repeats once) and how far back
words stood before. A truncated singular value decomposition of a bounded sample of
labelled texts gives the space. The sample's vectors are broadcast; each document's
cosines with all of them are computed in blocks, and its nearest neighbours vote
with the cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import quoted
from tessera.llm.text import U, Words, each_chunk, range_hashes

SAMPLE = 4096        # labelled texts at most that the space and the votes are taken from
WORDS = 1 << 14      # terms that words are hashed to
SHAPES = 1 << 10     # terms that shapes are hashed to
GAPS = 32            # terms of words' distances to where they stood before, by powers of two
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 4        # a neighbour's weight is its cosine to this power
ROUNDS = 3           # of the subspace iteration
BLOCK = 512          # documents whose cosines are computed together
TERMS = WORDS + SHAPES + GAPS


@dataclass
class Terms:
    """Terms of consecutive rows: those of row r are first[r] to first[r + 1]."""

    first: np.ndarray
    term: np.ndarray
    count: np.ndarray


def lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def classes() -> np.ndarray:
    """Bytes of shapes: small letters and all beyond ASCII, capitals, digits."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123], table[128:], table[65:91], table[48:58] = ord("a"), ord("a"), ord("A"), ord("0")
    return table


def terms(w: Words) -> Terms:
    """Terms of a chunk's rows with their counts; ``w.hash`` is of folded words."""
    rows = len(w.first) - 1
    kind = classes()[w.data]
    new = np.append(True, kind[1:] != kind[:-1])[:len(kind)]
    new[w.start] = True
    place = np.concatenate([[0], np.cumsum(new)])
    shape = range_hashes(kind[new], place[w.start], place[w.end])
    order = np.lexsort((w.hash, w.row))
    again = (w.hash[order[1:]] == w.hash[order[:-1]]) & (w.row[order[1:]] == w.row[order[:-1]])
    later = order[1:][again]
    gap = np.log2(later - order[:-1][again]).astype(np.int64)
    every = np.concatenate([w.row * TERMS + (w.hash & U(WORDS - 1)).astype(np.int64),
                            w.row * TERMS + WORDS + (shape & U(SHAPES - 1)).astype(np.int64),
                            w.row[later] * TERMS + WORDS + SHAPES + np.minimum(gap, GAPS - 1)])
    own, count = np.unique(every, return_counts=True)
    return Terms(np.searchsorted(own, np.arange(rows + 1) * TERMS), own % TERMS, count)


def weights(t: Terms, idf: np.ndarray) -> np.ndarray:
    """Weight of each term in its row: words, shapes and gaps have length 1 each."""
    value = ((1 + np.log(t.count)) * idf[t.term]).astype(np.float32)
    row = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    part = 3 * row + (t.term >= WORDS) + (t.term >= WORDS + SHAPES)
    length = np.sqrt(np.bincount(part, weights=value * value, minlength=3 * len(t.first)))
    return value / np.maximum(length[part], 1e-12).astype(np.float32)


def product(t: Terms, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of terms by a (term, dimension) matrix, a few rows at a time."""
    out = np.zeros((len(t.first) - 1, matrix.shape[1]), np.float32)
    for lo in range(0, len(out), 64):
        hi = min(lo + 64, len(out))
        a, b = t.first[lo], t.first[hi]
        full = np.flatnonzero(np.diff(t.first[lo:hi + 1]))
        if len(full):
            out[lo + full] = np.add.reduceat(matrix[t.term[a:b]] * value[a:b, None], t.first[lo + full] - a)
    return out


def transposed(t: Terms) -> tuple[Terms, np.ndarray]:
    """Rows of each term, and the order of the values."""
    order = np.argsort(t.term, kind="stable")
    row = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))[order]
    return Terms(np.searchsorted(t.term[order], np.arange(TERMS + 1)), row, t.count[order]), order


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Space:
    """The latent space of a sample of labelled texts, and their vectors in it.
    ``idf``: a weight for each term."""

    def __init__(self, sample: Terms, labels: np.ndarray, idf: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float32)
        value = weights(sample, idf)
        turned, order = transposed(sample)
        width = min(DIMENSIONS, max(len(labels), 1))
        basis = np.random.default_rng(11).standard_normal((TERMS, width + 8)).astype(np.float32)
        for _ in range(ROUNDS):
            inner, _ = np.linalg.qr(product(sample, value, basis))
            basis, _ = np.linalg.qr(product(turned, value[order], inner))
        _, _, right = np.linalg.svd(product(sample, value, basis), full_matrices=False)
        self.matrix = (basis @ right[:width].T).astype(np.float32)
        self.vectors = unit(product(sample, value, self.matrix))
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def scores(self, t: Terms) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest neighbours; the
        share in the sample where no neighbour has a positive cosine."""
        rows = unit(product(t, weights(t, self.idf), self.matrix))
        out = np.full(len(rows), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(rows) if k else 0, BLOCK):
            cosine = rows[lo:lo + BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            voted = total > 0
            out[lo:lo + BLOCK][voted] = ((weight * self.labels[near]).sum(axis=1)[voted] / total[voted]).clip(0, 1)
        return out


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning, by its key alone."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of ``texts`` and, for each of the TERMS terms, the rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            held[TERMS] += batch.num_rows
            for _, _, w in each_chunk(batch, "text", lower()):
                held[:TERMS] += np.bincount(terms(w).term, minlength=TERMS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    counts = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(TERMS + 1, np.int64)
    held[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return int(held[TERMS]), held[:TERMS]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Space:
    """The space of at most SAMPLE labelled texts that are not held out, those with
    the least hash of their key; term weights from all of ``docs``. Labels other than
    0 and 1 are none; several labels of a key are averaged, of several texts of
    a key the least is taken."""
    texts = docs.select(F.col(quoted(text)).alias("text"))
    n, held = _frequencies(texts)
    idf = np.where(held > 0, np.log((1 + n) / np.maximum(held, 1)), 0).astype(np.float32)
    known = labels.select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).cast("double").alias("label"))
    known = known.where(F.col("label").isin(0.0, 1.0) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.avg("label").alias("label"))
    own = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).where("text is not null")
    # the sampled keys are few by SAMPLE, and so is what is left of the documents
    chosen = known.join(own.select("key").distinct(), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    rows = own.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_chunk(batch, "text", lower()):
                t = terms(w)
                lists = [pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (t.term, t.count)]
                yield pa.RecordBatch.from_arrays([batch.column("order").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), *lists],
                                                 names=["order", "label", "term", "count"])

    rows = rows.select(F.xxhash64("key").alias("order"), "label", "text")
    sample = rows.mapInArrow(run, "order long, label double, term array<int>, count array<int>").orderBy("order").toArrow()
    term, count = (sample.column(c).combine_chunks() for c in ("term", "count"))
    first = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy())]).astype(np.int64) if len(term) else np.zeros(1, np.int64)
    flat = [x.flatten().to_numpy().astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (term, count)]
    return Space(Terms(first, *flat), sample.column("label").to_numpy(), idf)


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``held_out`` and ``score`` (0 to 1).

    A null or empty text, and one whose terms the sample does not have, gets the
    sample's share of label 1; without labels that is 0.5. A null key is not held
    out; repeated rows stay; an empty table gives an empty result; other columns pass
    through, those named like added ones are replaced. Only the text is read for the
    score. The space is broadcast: TERMS by DIMENSIONS and SAMPLE by DIMENSIONS numbers,
    whatever the corpus. Nothing is shuffled.
    """
    rows = docs.withColumn("held_out", held_out(F.col(quoted(key))))
    kept = [(i, f) for i, f in enumerate(rows.schema.fields) if f.name.lower() not in (text.lower(), "score")]
    body = next(i for i, f in enumerate(rows.schema.fields) if f.name.lower() == text.lower())
    names = [f.name for _, f in kept]
    shared = docs.sparkSession.sparkContext.broadcast((space.idf, space.labels, space.matrix, space.vectors, space.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space.__new__(Space)
        space.idf, space.labels, space.matrix, space.vectors, space.prior = shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(body)], names=["text"])
            for lo, hi, w in each_chunk(texts, "text", lower()):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i, _ in kept], pa.array(space.scores(terms(w)))],
                                                 names=[*names, "score"])

    return rows.mapInArrow(run, T.StructType([*[f for _, f in kept], T.StructField("score", T.DoubleType())]))
