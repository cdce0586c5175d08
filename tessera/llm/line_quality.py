"""Quality rules with cross-document line frequency.

Normalised lines are hashed and counted over the different documents of each host.
Lines above the limit are boilerplate and go; a document that loses most of
its words, or fails the base rules, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import quoted, set_aside
from tessera.llm.text import U, _BASE, _INVERSE, _powers, chunks, grams, mix, range_hashes, utf8, within, words
from tessera.session import materialize

LIMIT = 20           # different documents of one host that may hold a line
MIN_WORDS = 50       # base rule: words of a document
REPEAT_PERCENT = 50  # base rule: share of repeated words
KEPT_PERCENT = 30    # words that must be left of a document
LEFT_WORDS = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _fold() -> np.ndarray:
    """Hashing alphabet of normalised lines: ASCII letters lowered, digits 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    return table


def lines_of(w, data):
    """Lines that hold a word: row, first word, end word, byte start, byte end."""
    if not len(w):
        return (np.zeros(0, np.int64),) * 5
    cuts = np.unique(np.concatenate([w.offsets, np.flatnonzero(data == 10) + 1]))
    of = np.searchsorted(cuts, w.start, side="right") - 1
    head = np.flatnonzero(np.diff(of, prepend=-1))
    tail = np.append(head[1:], len(w))
    start, end = cuts[of[head]], cuts[of[head] + 1]
    end = end - (data[end - 1] == 10)
    return w.row[head], head, tail, start, end


def normal_hashes(w, data, head, tail) -> np.ndarray:
    """Hash of each line's words, with case, digits and spacing levelled."""
    h = range_hashes(_fold()[data], w.start, w.end)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _powers(_BASE, len(h)), dtype=U, out=total[1:])
    return mix((total[tail] - total[head]) * _powers(_INVERSE, len(h) + 1)[head] + (tail - head).astype(U))


def _measured(data: np.ndarray, offsets: np.ndarray):
    """Counts per row, and its different normalised lines."""
    w = words(data, offsets)
    data, offsets, n = w.data, w.offsets, len(w.first) - 1

    def per_row(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    spaces = np.zeros(256, bool)
    spaces[[9, 10, 11, 12, 13, 32]] = True
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in "#*$%&|<>"]] = True
    chars = ((data & 0xC0) != 0x80) & ~spaces[data]

    row, head, tail, start, end = lines_of(w, data)
    apart = mix(np.arange(1, n + 1, dtype=U))
    raw = range_hashes(data, start, end) ^ apart[row]
    _, seen = np.unique(raw, return_index=True)
    dup = np.bincount(row, minlength=n) - np.bincount(row[seen], minlength=n)

    repeat = np.zeros(len(w), bool)
    inside = np.flatnonzero(within(w, 3))
    if len(inside):
        three = grams(w.hash, 3)[inside] ^ apart[w.row[inside]]
        order = np.argsort(three)
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        for j in range(3):
            repeat[at + j] = True
    counts = [np.diff(w.first), per_row(chars), per_row(symbols[data]), dup, np.bincount(w.row[repeat], minlength=n)]

    line = normal_hashes(w, data, head, tail)
    _, first, again = np.unique(line ^ apart[row], return_index=True, return_inverse=True)
    size = np.bincount(again, weights=tail - head, minlength=len(first)).astype(np.int32)
    order = np.argsort(first)
    first, size = first[order], size[order]
    lines = pa.StructArray.from_arrays([pa.array(line[first].view(np.int64)), pa.array(size)], names=["line", "words"])
    at = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))]).astype(np.int32)
    return counts, pa.ListArray.from_arrays(pa.array(at), lines)


LINES = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())]))


def measure(docs: DataFrame, text: str = "text", drop_text: bool = True) -> DataFrame:
    """``docs`` with the base counts and an array of its normalised lines."""
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("lines", LINES)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for lo, hi in chunks(offsets):
                counts, lines = _measured(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1])
                same = [batch.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, pa.int64()) for c in counts], lines],
                                                 names=[*names, *COUNTS, "lines"])

    return docs.mapInArrow(run, schema)


def _cut(rows: DataFrame) -> DataFrame:
    """Removes the lines of ``gone`` from ``text``."""

    @F.pandas_udf("string")
    def cut(texts, gone):
        out = []
        for text, hashes in zip(texts, gone):
            if text is None or hashes is None:
                out.append(text)
                continue
            raw = text.encode()
            w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            _, head, tail, start, end = lines_of(w, w.data)
            bad = np.isin(normal_hashes(w, w.data, head, tail).view(np.int64), np.asarray(hashes, np.int64))
            kept, at = [], 0
            for a, b in zip(start[bad], end[bad]):
                kept.append(raw[at:a])
                at = min(b + 1, len(raw))
            out.append((b"".join(kept) + raw[at:]).decode())
        import pandas as pd
        return pd.Series(out, dtype=object)

    return rows.withColumn("text", cut("text", "gone"))


def _common(lines: DataFrame, limit: int) -> DataFrame:
    """(key) of the lines (key, digest) that more than ``limit`` different texts hold.
    Equal pairs are combined before the shuffle and dealt out by both columns, so a
    line that very many documents hold is counted by many tasks."""
    held = lines.groupBy("key", "digest").agg(F.lit(1).alias("one"))
    return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key")


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: int = LIMIT, cut: bool = False) -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed``,
    ``n_common_lines`` and ``common_words`` (different lines above the limit
    and the words in them) and ``kept``. With ``cut``, the text stays, without
    those lines.

    A line is its words with ASCII case, digits and spacing levelled. It is
    above the limit if more than ``limit`` different documents of the host hold
    it, whatever its neighbours. Equal texts are one document, so a text that is
    copied often is left to deduplication; texts that differ at all are different
    documents, so pages that are nearly only boilerplate are depleted by it, and
    so are more than ``limit`` edited copies of one text in one host. A document is
    depleted if under ``KEPT_PERCENT`` of its words or under ``LEFT_WORDS`` are left.

    A null text is empty and fails the base rules; a null host is a host;
    repeated rows are copies; an empty table gives an empty
    result; other columns pass through, those named like added ones are
    replaced. The lines' hashes are written to the shared folder and grouped
    with partial counts, so a line that a third of all documents hold is one
    partial row per task.
    """
    added = [*COUNTS, "base_failed", "n_common_lines", "common_words", "kept"]
    aside, back = set_aside(docs, text, *added)
    digest = F.xxhash64(F.col(quoted(text))).alias("digest")
    rows = docs.select(*aside, F.xxhash64(F.lit("host"), F.col(quoted(host))).alias("host"), digest, F.col(quoted(text)).alias("text"))
    rows = materialize(measure(rows, drop_text=not cut), "lines").withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "host", "digest", F.explode("lines").alias("l")).select(
        "row", "digest", F.xxhash64("host", "l.line").alias("key"), "l.line", "l.words")
    common = _common(lines.select("key", "digest"), limit)
    gone = lines.join(common, "key").groupBy("row").agg(
        F.count("*").alias("n_common_lines"), F.sum("words").cast("long").alias("common_words"),
        *([F.collect_set("line").alias("gone")] if cut else []))
    rows = rows.drop("lines").join(gone, "row", "left").fillna(0, ["n_common_lines", "common_words"])
    if cut:
        rows = _cut(rows)
    left = F.col("n_words") - F.col("common_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (left < LEFT_WORDS) | (100 * left < KEPT_PERCENT * F.col("n_words"))
    return rows.select(*back, *(["text"] if cut else []), *COUNTS, failed.alias("base_failed"), "n_common_lines", "common_words",
                       (~failed & ~depleted).alias("kept"))
