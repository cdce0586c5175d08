"""Substring dedup with suffix automata of reference shards.

Every document is reference for those after it, so the reference is the
corpus: it is cut into shards, and a shard meets only the text that can match
it. The shard of a window is its minimiser (the five words of least hash), which
equal windows share. A shard's task streams its segments in the order of the
documents: each is run through the suffix automaton of the earlier documents'
segments (matching statistics), windows inside matches of the window length or
more are covered, and the segment then extends the automaton.

Automata of a whole corpus grow with it and are matched against all of it, so
they aren't broadcast; a fixed reference list would be one more document with
the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import quoted
from tessera.llm.text import U, Words, each_chunk, grams, within

WINDOW = 13
ANCHOR = 5       # words of a minimiser
SLICE = 256      # rows whose texts are unpacked at a time
CROWDED = 1000   # documents of a shard; beyond, its windows are shards of their own, in salted parts

SEGMENT = "route long, salt long, doc_id long, tag int, at int, tokens binary"
PASSED = "route long, doc_id long, tag int, at int, until int, tokens binary"


class Automaton:
    """A suffix automaton of several token sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens: list[int]) -> None:
        follow, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            p, fresh = last, c not in follow[last]
            if fresh:
                last = len(follow)
                follow.append({})
                length.append(length[p] + 1)
                link.append(0)
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = last
                    p = link[p]
                if p < 0:
                    continue
            q = follow[p][c]
            if length[p] + 1 != length[q]:
                clone = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                q = clone
            if fresh:
                link[last] = q
            else:
                last = q

    def statistics(self, tokens: list[int]) -> list[int]:
        """Length of the longest match that ends at each token."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in tokens:
            while c not in follow[state]:
                state = link[state]
                if state < 0:
                    state = size = 0
                    break
                size = length[state]
            else:
                state = follow[state][c]
                size += 1
            out.append(size)
        return out


def minimisers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: (first window, end window, minimiser);
    a window is known by its first word."""
    anchors = grams(w.hash, ANCHOR)
    n = len(w) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    least = anchors[:n].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, anchors[j:j + n], out=least)
    whole = within(w, WINDOW)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | ~whole[:-1] | (w.row[1:n] != w.row[:n - 1])])
    first = np.flatnonzero(new & whole)
    last = np.flatnonzero(np.concatenate([new[1:] | ~whole[1:], [True]]) & whole)
    return first, last + 1, least[first]


def _marks(docs: DataFrame) -> DataFrame:
    """(mark, doc_id): the different minimisers of each document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, w in each_chunk(batch):
                first, _, mark = minimisers(w)
                row = w.row[first]
                order = np.lexsort((mark, row))
                row, mark = row[order], mark[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(mark[new].view(np.int64)), pa.array(ids[lo + row[new]])], names=["mark", "doc_id"])

    return docs.mapInArrow(run, "mark long, doc_id long")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts compressed, for shuffles of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                raw = [t.as_buffer() for t in part.column("text").fill_null("")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), pa.array([len(t) for t in raw], pa.int64()),
                     pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary())], names=["doc_id", "tag", "size", "packed"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag int, size long, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, with the texts' bytes as ``text``."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = [pa.decompress(p.as_buffer(), n.as_py(), codec="zstd", asbytes=True) for p, n in zip(part.column("packed"), part.column("size"))]
            yield part.append_column("text", pa.array(texts, pa.binary()))


def _segments(docs: DataFrame) -> DataFrame:
    """Segments of (doc_id, tag, packed, wanted) for their shards: the words of
    each run of windows whose minimiser is wanted."""
    schema = pa.schema([("route", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            batch = batch.filter(batch.column("wanted").is_valid())
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            wanted = batch.column("wanted")
            for lo, hi, w in each_chunk(batch):
                first, end, mark = minimisers(w)
                row = w.row[first]
                own = wanted.slice(lo, hi - lo)
                holder = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
                marks = own.flatten()
                docs_of, marks = marks.field(1).to_numpy(), marks.field(0).to_numpy().view(U)
                # both sides by row and mark
                keys = np.concatenate([np.rec.fromarrays([holder, marks]), np.rec.fromarrays([row, mark])]) if len(first) else np.zeros(0)
                if not len(keys):
                    continue
                _, inverse = np.unique(keys, return_inverse=True)
                known = np.zeros(inverse.max() + 1, np.int64)
                known[inverse[:len(marks)]] = docs_of
                crowd = known[inverse[len(marks):]]
                good = np.flatnonzero(crowd)
                yield from _pieces(w, ids[lo:hi], tags[lo:hi], first[good], end[good], mark[good], crowd[good])

    def _pieces(w, ids, tags, first, end, mark, crowd):
        tokens = (w.hash >> U(32)).astype(np.uint32)
        raw = tokens.tobytes()
        # crowded shards: every window on its own, under its own hash
        many = crowd > CROWDED
        size = end[many] - first[many]
        windows = np.repeat(first[many] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if many.any() else np.zeros(0, np.int64)
        salts = np.repeat(crowd[many] // CROWDED + 1, size)
        whole = grams(w.hash, WINDOW)
        start = np.concatenate([first[~many], windows])
        until = np.concatenate([end[~many] + WINDOW - 1, windows + WINDOW])
        route = np.concatenate([mark[~many], whole[windows]])
        row = w.row[start]
        salt = np.concatenate([np.full((~many).sum(), -1), (ids[row[len(row) - len(windows):]] * 2654435761 >> 7) % salts])
        pieces = [raw[4 * a:4 * b] for a, b in zip(start.tolist(), until.tolist())]
        for at in range(0, len(start), 1 << 15):
            part = slice(at, at + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array(route[part].view(np.int64)), pa.array(salt[part], pa.int64()), pa.array(ids[row[part]]), pa.array(tags[row[part]]),
                                              pa.array((start - w.first[row])[part], pa.int32()), pa.array(pieces[part], pa.binary())], schema=schema)

    return docs.mapInArrow(run, SEGMENT)


def _runs(matched: list[int]) -> Iterator[tuple[int, int]]:
    """Token ranges that windows inside matches cover."""
    a = b = -1
    for i, size in enumerate(matched):
        if size >= WINDOW:
            if i - WINDOW + 1 > b:
                if b > 0:
                    yield a, b
                a = i - WINDOW + 1
            b = i + 1
    if b > 0:
        yield a, b


def _streamed(segments: DataFrame, final: bool) -> DataFrame:
    """Runs each shard's segments, in the order of doc_id, through its automaton.
    Returns covered word ranges (``until`` above 0). Salted parts of a shard see
    a part of its documents; what none of those cover goes on with its tokens."""
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("until", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, seen, doc, pending = None, None, None, None, []
        out = []
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(c).to_pylist() for c in ("route", "salt" if "salt" in names else "until", "doc_id", "tag", "at", "tokens")]
            for route, salt, d, tag, at, tokens in zip(*columns):
                if final and salt > 0:  # covered before
                    out.append((0, d, tag, at, salt, None))
                    continue
                if shard != (route, salt):
                    shard, automaton, seen, doc, pending = (route, salt), Automaton(), set(), d, []
                elif doc != d:
                    for own in pending:
                        if own not in seen:
                            seen.add(own)
                            automaton.add(np.frombuffer(own, np.uint32).tolist())
                    doc, pending = d, []
                if tokens in seen:
                    out.append((0, d, tag, at, at + len(tokens) // 4, None))
                else:
                    if seen:
                        covered = list(_runs(automaton.statistics(np.frombuffer(tokens, np.uint32).tolist())))
                        out += [(0, d, tag, at + a, at + b, None) for a, b in covered]
                    else:
                        covered = []
                    pending.append(tokens)
                    if not final and salt >= 0 and not covered:
                        out.append((route, d, tag, at, 0, tokens))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return segments.mapInArrow(run, PASSED)


def covered(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc_id, spans) of the documents (doc_id, tag, text) that have words to
    remove; ``spans``: (tag, at, until) ranges of words."""
    named = docs.where("doc_id is not null").select("doc_id", "text")
    marks = _marks(named)
    shared = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    wanted = marks.join(shared, "mark").groupBy("doc_id").agg(F.collect_set(F.struct("mark", "n")).alias("wanted"))
    segments = _segments(packed.join(wanted, "doc_id", "left").select("doc_id", "tag", "size", "packed", "wanted"))
    segments = segments.repartition("route", "salt").sortWithinPartitions("route", "salt", "doc_id")
    passed = _streamed(segments, final=False)
    passed = passed.withColumn("by", F.when(F.col("until") > 0, F.xxhash64("doc_id")).otherwise(F.col("route")))
    passed = passed.repartition("by").sortWithinPartitions("route", "doc_id").drop("by")
    return _streamed(passed, final=True).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "at", "until")).alias("spans"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; ``kept``: its kept
    words joined by one space.

    A word goes if a window of WINDOW words over it, inside one document, also
    starts in a document with a smaller doc_id. Windows are judged on the input.

    A null or empty text has no words; documents with a null key neither cover
    others nor are covered; rows with one key never cover each other; an empty
    table gives an empty result; other columns are ignored. Key must be a long.

    Windows whose minimiser stands in one document only can't repeat and go
    nowhere. Minimisers are counted with partial counts and joined back, a join
    that Spark splits on skew. A shard of more than CROWDED documents is a
    passage in common: there each window is a shard of its own, first in salted
    parts of about CROWDED documents, then among the parts' first holders. A
    task holds the different segments of one shard.
    """
    own = docs.select(F.col(quoted(key)).alias("doc_id"), F.hash(F.col(quoted(text))).alias("tag"), F.col(quoted(text)).alias("text"))
    packed = _packed(own)  # its shuffle serves both joins by doc_id
    spans = covered(own, packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unpacked(batches):
            counts, gone, kept = [], [], []
            for tag, text, ranges in zip(*(part.column(c).to_pylist() for c in ("tag", "text", "spans"))):
                w = text.split()
                counts.append(len(w))
                bad = np.zeros(len(w), bool)
                for r in ranges or ():
                    if r["tag"] == tag:
                        bad[r["at"]:r["until"]] = True
                gone.append(int(bad.sum()))
                kept.append(b" ".join(w if not gone[-1] else [w[i] for i in np.flatnonzero(~bad)]).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    rows = packed.join(spans, "doc_id", "left").select("doc_id", "tag", "size", "packed", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
