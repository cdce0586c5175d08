"""Line dedup by a deletion-neighbourhood join.

Two lines are within one word edit if one is the other without a word, or if
both without their words at one place are equal. So every line emits itself
and its variants without each word as hashed keys; lines with equal keys are
candidates, the edit distance verifies them, and the earliest line stays.

The variants of a whole line without k words grow with the k-th power of its
length, so longer lines, which may differ in more words, are cut into segments
before words chosen by their hash. An edit changes at most two segments of either
line. So a line that has more than 2 * k segments that no other line has is near
none: this is counted first, over all lines, and few lines are left. Of these,
lines within k edits have an unchanged segment in common among the 2 * k
+ 1 of each that come first in any fixed order of all segments; here the longest.

Keys are many and small, so they travel as packed arrays by bucket, and are sorted
and counted there; a Spark row holds the keys that one task has for one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import quoted, set_aside
from tessera.llm.line_quality import lines_of
from tessera.llm.text import U, each_chunk, mix, seeds, spans, without_each
from tessera.session import materialize

MIN_WORDS = 8    # shorter lines are removed only if equal
EDIT_WORDS = 10  # words of the shorter line for each edit between near lines; one edit is always allowed
LONG_WORD = 8    # bytes of a word that always starts a segment where all segments are counted; half of those over half as long do
CUTS = (2, 1)    # words per segment start on average, of those that lines are joined by; the next for lines with too few segments
BITS = 256       # of the parity map of a longer line
FLUSH = 1 << 21  # keys that a task packs at once
PAIRS = 1 << 18  # pairs that are held against each other at once
MAP_BITS = 1 << 28  # most bits of a map of the lines to read; beyond, more lines share a bit and are read for nothing

KEYS, LINES, NEED, SHARED, EQUAL, DOCS = range(6)
PACKED = "bucket int, kind byte, data binary"
AT = np.dtype([("content", U), ("high", U), ("low", U), ("row", np.int64)])
GONE = np.dtype([("row", np.int64), ("line", np.int64)])
DOC = np.dtype([("row", np.int64), ("doc_id", np.int64), ("known", np.int64), ("tag", np.int64), ("n_lines", np.int64)])
RECORD = np.dtype([("key", U), ("high", U), ("low", U), ("content", U), ("n", np.int64), ("bits", U, (BITS // 64,))])


def _halves(w, head, tail) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the starts and ends that lines within one edit share: at
    the edit, one side of at least half the shorter line's words is equal. A line
    gives the halves of its own length and of one word less. Pairs of longer lines
    are found by their segments."""
    n = tail - head
    lines = np.flatnonzero((n >= MIN_WORDS) & (n <= 2 * EDIT_WORDS))
    out = []
    for side in (0, 1):
        for less in (0, 1):
            half = (n[lines] - less) // 2
            use = np.ones(len(lines), bool) if less == 0 else half != n[lines] // 2
            a = head[lines] if side == 0 else tail[lines] - half
            key = mix(spans(w.hash, a, a + half) ^ seeds(2, 5)[side])
            out.append((lines[use], key[use]))
    return np.concatenate([x for x, _ in out]), np.concatenate([k for _, k in out])


def _numbers(w, row, start) -> np.ndarray:
    """Line numbers in their rows: newlines before them."""
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    return breaks[start] - breaks[w.offsets[row]]


def _cut(hashes, head, tail, lines, chosen, salt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, words) of all segments of some lines; ``chosen``: words that cut.

    A segment goes from a chosen word, or the line's first,
    up to the next such word, which it includes. A word is in two segments at most and
    the place between two words in one, so substituting, adding or deleting a word
    leaves all but two segments of either line as they were: of two lines within k edits
    each has at most 2 * k segments that the other lacks, equal ones counted apart.
    So the keys of equal segments of a line differ by their number."""
    n = tail - head
    cut = chosen.copy()
    cut[head] = True
    wanted = np.zeros(len(n), bool)
    wanted[lines] = True
    cut &= np.repeat(wanted, n)
    a = np.flatnonzero(cut)
    line = np.repeat(np.arange(len(n)), n)[a]
    last = np.append(line[1:] != line[:-1], True)[:len(line)]
    b = np.where(last, tail[line], np.append(a[1:], 0)[:len(a)] + 1)
    key = mix(spans(hashes, a, b) ^ salt)
    own = key + line.astype(U) * U(0x9E3779B97F4A7C15)
    order = np.argsort(own)
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])[:len(order)]
    if same.any():
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        number = (np.arange(len(order)) - first)[same].astype(U)
        key[order[same]] = mix(key[order[same]] + number * U(0xD6E8FEB86659FD93))
    return line, key, b - a


def _segments(w, head, tail) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the segments that long lines within the allowed edits share.

    If a line has more than 2 * k segments, those that it shares with one within k edits are
    not all among its others, so the first 2 * k + 1 of both in one order of all segments
    hold a common one. A line with no more gives the next level's as well; if both
    lines are such, both do. On the last level each word is a segment, which is
    over 2 * k of them."""
    n = tail - head
    lines = np.flatnonzero(n >= 2 * EDIT_WORDS)
    found, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for level, salt in zip(CUTS, seeds(len(CUTS), 21)):
        if not len(lines):
            break
        line, key, length = _cut(w.hash, head, tail, lines, mix(w.hash ^ salt) % U(level) == 0, salt)
        order = np.lexsort((key, -length, line))
        line, key = line[order], key[order]
        most = 2 * (n // EDIT_WORDS) + 1
        use = np.arange(len(line)) - np.searchsorted(line, line) < most[line]
        found.append(line[use])
        keys.append(key[use])
        lines = lines[np.bincount(line, minlength=len(n))[lines] < most[lines]]
    return np.concatenate(found), np.concatenate(keys)


def _counted(w, head, tail) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) of what is counted, and (line, need): how many of its keys another line
    must have, or the line has none that is near."""
    n = tail - head
    long = np.flatnonzero(n >= 2 * EDIT_WORDS)
    salt, size = seeds(1, 22)[0], w.end - w.start
    # words of more bytes are less common, so that a segment with one or two of them is seldom in other lines
    chosen = (size >= LONG_WORD) | (size > LONG_WORD // 2) & (mix(w.hash ^ salt) % U(2) == 0)
    line, key, _ = _cut(w.hash, head, tail, long, chosen, salt)
    need = np.bincount(line, minlength=len(n)) - 2 * (n // EDIT_WORDS)
    need = np.where(n > 2 * EDIT_WORDS, need, np.where(n == 2 * EDIT_WORDS, np.minimum(need, 1), 1))
    of, half = _halves(w, head, tail)
    lines = np.flatnonzero(n >= MIN_WORDS)
    return np.concatenate([line, of]), np.concatenate([key, half]), lines, np.maximum(need[lines], 0)


def _parities(w, head, tail) -> tuple[np.ndarray, np.ndarray]:
    """(line, BITS / 64 numbers) of long lines: whether an odd number of the
    words falls into each bucket. An edit changes two of these bits at most."""
    n = tail - head
    lines = np.flatnonzero(n >= 2 * EDIT_WORDS)
    bucket = mix(w.hash ^ seeds(1, 23)[0]) % U(BITS)
    bits = np.zeros((len(n), BITS // 64), U)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(n)), n), (bucket >> U(6)).astype(np.int64)), U(1) << (bucket & U(63)))
    return lines, bits[lines]


def _high_low(ids: pa.Array, rows: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of lines as two numbers: by document, then line; null keys last."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)[rows]
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)[rows] ^ U(1 << 63)
    return np.where(known, own, ~U(0)), line.astype(U) | np.where(known, U(0), U(1 << 32))


def _ident(content: np.ndarray) -> np.ndarray:
    """Number of a line's content where keys are counted. Contents of one number only count
    more shared keys, and stay in; that near ones have one number has a chance of 2 ** -32."""
    return content & U(0xFFFFFFFF)


def _dealt(kind: int, bucket: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, kind, values) of each bucket."""
    bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(bucket))):
        yield int(bucket[a]), kind, values[a:b]


def _packed(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for at in range(0, len(rows), 4096):
        part = rows[at:at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int8()), pa.array([x[2].tobytes() for x in part], pa.binary())],
                                         names=["bucket", "kind", "data"])


def _by_bucket(packed: DataFrame) -> DataFrame:
    """Packed rows, those of a bucket together, for ``_each_bucket``: a task holds one bucket at a time."""
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its rows' (kind, data))."""
    rows = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))))
    for bucket, own in groupby(rows, key=itemgetter(0)):
        yield bucket, [x[1:] for x in own]


def _joined(rows: list[tuple[int, bytes]], kind: int, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for k, x in rows if k == kind)])


def _buckets(df: DataFrame, most: int) -> int:
    """Bits of a bucket's number: some buckets for each shuffle partition."""
    return min(most, (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[:len(x)])
    return start, np.diff(np.append(start, len(x)))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[_runs(x)[0]]


def _sharing(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different sorted (key, ident): whether another ident has the key, and whether it is
    the key's first or last."""
    start, size = _runs(pairs >> U(32))
    edge = np.zeros(len(pairs), bool)
    edge[start] = edge[start + size - 1] = True
    return np.repeat(size > 1, size), edge


def _copies(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal lines (AT), with others at their place, and the later ones."""
    at = at[np.lexsort((at["low"], at["high"], at["content"]))]
    start, size = _runs(at["content"])
    first = np.repeat(start, size)
    least = (at["high"] == at["high"][first]) & (at["low"] == at["low"][first])
    return at[least], at[~least]


def _gone(at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), GONE)
    out["row"], out["line"] = at["row"], at["low"] & U(0xFFFFFFFF)
    return out


def _scanned(docs: DataFrame, bits: int, few: int) -> DataFrame:
    """What is counted of (doc_id, tag, text), packed by bucket. What a task finds shared, or
    a later copy, is not sent, so a key or a line that very many rows have is sent twice by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        count = task << 40
        held: dict[int, list[np.ndarray]] = {k: [] for k in (KEYS, LINES, NEED, DOCS)}
        top: list[np.ndarray] = []

        def flush():
            out = []
            if held[DOCS]:
                out.append((task % (1 << bits), DOCS, np.concatenate(held[DOCS])))
            if held[LINES]:
                least, later = _copies(np.concatenate(held[LINES]))
                out.extend(_dealt(LINES, least["content"] >> U(64 - bits), least))
                if len(later):
                    out.append((task % (1 << bits), EQUAL, _gone(later)))
                need = _distinct(np.concatenate(held[NEED]))
                out.extend(_dealt(NEED, need >> U(64 - few), need))
                shared = []
                for bucket, kind, pairs in _dealt(KEYS, np.concatenate(top), np.concatenate(held[KEYS])):
                    pairs = _distinct(pairs)
                    several, edge = _sharing(pairs)
                    out.append((bucket, kind, pairs[edge]))
                    shared.append(pairs[several & ~edge])
                out.extend(_tallied(np.concatenate([x & U(0xFFFFFFFF) for x in shared]) if shared else np.zeros(0, U), few))
            for x in (*held.values(), top):
                x.clear()
            yield from _packed(out)

        size = 0
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag").to_numpy(zero_copy_only=False)
            for lo, hi, w in each_chunk(batch):
                row, head, tail, start, _ = lines_of(w, w.data)
                own = ids.slice(lo, hi - lo)
                doc = np.zeros(hi - lo, DOC)
                doc["row"], doc["tag"], doc["n_lines"] = count + np.arange(hi - lo), tags[lo:hi], np.bincount(row, minlength=hi - lo)
                doc["doc_id"], doc["known"] = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)
                held[DOCS].append(doc)
                if len(row):
                    at = np.zeros(len(row), AT)
                    at["content"], at["row"] = spans(w.hash, head, tail), count + row
                    at["high"], at["low"] = _high_low(own, row, _numbers(w, row, start))
                    held[LINES].append(at)
                    line, key, lines, need = _counted(w, head, tail)
                    ident = _ident(at["content"])
                    held[KEYS].append((key << U(32)) | ident[line])
                    top.append((key >> U(64 - bits)).astype(np.uint16))
                    held[NEED].append((ident[lines] << U(32)) | need.astype(U))
                    size += len(key) + len(row)
                count += hi - lo
                size += hi - lo
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, PACKED)


def _tallied(idents: np.ndarray, few: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """How often each ident is there."""
    idents = np.sort(idents)
    start, size = _runs(idents)
    yield from _dealt(SHARED, idents[start] >> U(32 - few), (idents[start] << U(32)) | size.astype(U))


def _met(packed: DataFrame, few: int) -> DataFrame:
    """The counted keys met in their buckets: (ident, shared keys); and lines: later copies. The rest stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, size = [], 0
        for bucket, rows in _each_bucket(batches):
            out = [(bucket, kind, np.frombuffer(x, np.uint8)) for kind, x in rows if kind not in (KEYS, LINES)]
            _, later = _copies(_joined(rows, LINES, AT))
            if len(later):
                out.append((bucket, EQUAL, _gone(later)))
            pairs = _distinct(_joined(rows, KEYS, U))
            shared.append(pairs[_sharing(pairs)[0]] & U(0xFFFFFFFF))
            size += len(shared[-1])
            if size > FLUSH:
                out.extend(_tallied(np.concatenate(shared), few))
                shared, size = [], 0
            yield from _packed(out)
        if size:
            yield from _packed(_tallied(np.concatenate(shared), few))

    return _by_bucket(packed).mapInArrow(run, PACKED)


def _left(met: DataFrame) -> DataFrame:
    """The idents of the lines with as many shared keys as they need, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _each_bucket(batches):
            need, shared = _distinct(_joined(rows, NEED, U)), np.sort(_joined(rows, SHARED, U))
            start, _ = _runs(need >> U(32))  # an ident's least need comes first
            ident, need = need[start] >> U(32), need[start] & U(0xFFFFFFFF)
            total = np.concatenate([np.zeros(1, U), np.cumsum(shared & U(0xFFFFFFFF), dtype=U)])
            shared = shared >> U(32)
            have = total[np.searchsorted(shared, ident, side="right")] - total[np.searchsorted(shared, ident)]
            yield from _packed([(bucket, 0, ident[have >= need])])

    return _by_bucket(met.where(F.col("kind").isin(NEED, SHARED))).mapInArrow(run, PACKED)


def _idents(contents: DataFrame, few: int) -> DataFrame:
    """The idents of (content), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident = _ident(batch.column("content").to_numpy().view(U))
            yield from _packed(_dealt(0, ident >> U(32 - few), ident))

    return contents.select("content").mapInArrow(run, PACKED)


def _spots(ident: np.ndarray, wide: int, few: int) -> Iterator[np.ndarray]:
    """The bits of idents in a map, all in the part of their bucket."""
    part = ident >> U(32 - few) << U(wide - few)
    for salt in seeds(4, 24):
        yield (part | mix(ident ^ salt) & U((1 << (wide - few)) - 1)).astype(np.int64)


def _map(packed: DataFrame, few: int) -> tuple[int, int, np.ndarray]:
    """(bits of its size, of a bucket's number, bytes) of a Bloom filter of packed idents. Each bucket
    makes its part; the driver gets MAP_BITS at most, however many idents there are."""
    total = packed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    wide = min(MAP_BITS.bit_length() - 1, max(16, (2 * total).bit_length()))  # an ident's 8 bytes get 16 bits or more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _each_bucket(batches):
            part = np.zeros(1 << (wide - few), bool)
            for at in _spots(_joined(rows, 0, U), wide, few):
                part[at & ((1 << (wide - few)) - 1)] = True
            yield from _packed([(bucket, 0, np.packbits(part, bitorder="little"))])

    out = np.zeros((1 << wide) >> 3, np.uint8)
    size = (1 << (wide - few)) >> 3
    for r in _by_bucket(packed).mapInArrow(run, PACKED).collect():
        out[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["data"], np.uint8)
    return wide, few, out


def _is_in(content: np.ndarray, held: tuple[int, int, np.ndarray]) -> np.ndarray:
    """Whether a map has these contents: all that it was made of, and few others."""
    wide, few, bits = held
    good = np.ones(len(content), bool)
    for at in _spots(_ident(content), wide, few):
        good &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return good


def _tokens(docs: DataFrame, held) -> DataFrame:
    """(content, doc_id, tag, line, n, tokens) of the lines of (doc_id, tag, text) that a map holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_chunk(batch):
                row, head, tail, start, _ = lines_of(w, w.data)
                content = spans(w.hash, head, tail)
                good = np.flatnonzero((tail - head >= MIN_WORDS) & _is_in(content, held.value))
                if len(good):
                    raw = (w.hash >> U(32)).astype(np.uint32).tobytes()
                    take = pa.array(lo + row[good])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(content[good].view(np.int64)), batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(_numbers(w, row, start)[good].astype(np.int32)),
                         pa.array((tail - head)[good].astype(np.int32)), pa.array([raw[4 * a:4 * b] for a, b in zip(head[good], tail[good])], pa.binary())],
                        names=["content", "doc_id", "tag", "line", "n", "tokens"])

    return docs.mapInArrow(run, "content long, doc_id long, tag long, line int, n int, tokens binary")


def variants(lines: DataFrame) -> DataFrame:
    """(key, whole, place, content) of (content, place, tokens): ``whole`` keys are the line, and
    the line but for the word at one place; others are the line without a word."""
    salts = seeds(1 << 12, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, whole, source = [], [], []
                for i, raw in enumerate(part.column("tokens").to_pylist()):
                    h = mix(np.frombuffer(raw, np.uint32).astype(U))
                    less = without_each(h)
                    own = spans(h, np.array([0]), np.array([len(h)]))
                    place = np.arange(len(h))
                    gap = mix(less ^ salts[place % len(salts)] + place.astype(U))
                    less = np.unique(less)  # equal neighbours give one variant
                    keys += own, gap, less
                    whole.append(np.arange(1 + len(gap) + len(less)) <= len(gap))
                    source.append(np.full(1 + len(gap) + len(less), i))
                if keys:
                    source = pa.array(np.concatenate(source))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(whole)),
                                                      part.column("place").take(source), part.column("content").take(source)],
                                                     names=["key", "whole", "place", "content"])

    return lines.select("content", "place", "tokens").mapInArrow(run, "key long, whole boolean, place decimal(38,0), content long")


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are within one edit."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    differ = np.flatnonzero(a[:len(b)] != b)
    if not len(differ):
        return True
    i = differ[0]
    return np.array_equal(a[i + 1:], b[i + (len(a) == len(b)):])


def within(a: np.ndarray, b: np.ndarray, k: int) -> bool:
    """Whether two word sequences are within ``k`` edits: the furthest word of
    ``a`` that each diagonal reaches with so many edits."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    x, y = a.tolist(), b.tolist()
    before: dict[int, int] = {}
    for e in range(k + 1):
        reach: dict[int, int] = {}
        for d in range(-e, e + 1):
            i = max(before.get(d, -2) + 1, before.get(d - 1, -2), before.get(d + 1, -2) + 1) if e else 0
            if i < max(0, -d):
                continue
            i = min(i, n, m - d)
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            if i == n and i + d == m:
                return True
            reach[d] = i
        before = reach
    return False


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lines are within the edits allowed for the shorter one."""
    k = min(len(a), len(b)) // EDIT_WORDS
    if k <= 1:
        return within_one(a, b)
    if len(a) == len(b) and np.count_nonzero(a != b) <= k:
        return True
    return within(a, b, k)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows of a column of tokens, and the row offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] // 4
    data = np.frombuffer(data, np.uint8).view(np.uint32) if data is not None else np.zeros(0, np.uint32)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _lacking(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """For each pair of rows, how many words of one, in any order, the other lacks: an edit
    changes one word of a line, so lines within k edits lack k at most."""
    pair = np.concatenate([np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in (a_at, b_at)]).astype(U)
    side = np.repeat(np.array([0, 1], U), [len(a), len(b)])
    both = np.sort((pair << U(33)) | (np.concatenate([a, b]).astype(U) << U(1)) | side)
    start, size = _runs(both >> U(1))
    more = size - 2 * np.add.reduceat((both & U(1)).astype(np.int64), start) if len(start) else size
    pair = (both[start] >> U(33)).astype(np.int64)
    n = len(a_at) - 1
    return np.maximum(np.bincount(pair, np.maximum(more, 0), n), np.bincount(pair, np.maximum(-more, 0), n))


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, a_at = _words(batch.column("tokens"))
            b, b_at = _words(batch.column("other"))
            edits = np.maximum(np.minimum(np.diff(a_at), np.diff(b_at)) // EDIT_WORDS, 1)
            good = np.zeros(batch.num_rows, bool)
            total = a_at + b_at
            lo = 0
            while lo < len(good):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
                lacking = _lacking(a[a_at[lo]:a_at[hi]], a_at[lo:hi + 1] - a_at[lo], b[b_at[lo]:b_at[hi]], b_at[lo:hi + 1] - b_at[lo])
                for i in lo + np.flatnonzero(lacking <= edits[lo:hi]):
                    good[i] = alike(a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]])
                lo = hi
            yield batch.select(["content"]).filter(pa.array(good))

    return pairs.select("content", "tokens", "other").mapInArrow(run, "content long")


def _records(lines: DataFrame, bits: int) -> DataFrame:
    """The segment keys (RECORD) of different (content, doc_id, line, n, tokens), packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _words(batch.column("tokens"))
            content, line = (batch.column(c).to_numpy() for c in ("content", "line"))
            high, low = _high_low(batch.column("doc_id"), np.arange(len(content)), line)
            out = []
            lo = 0
            while lo < len(content):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAIRS, side="right")) - 1)
                w = SimpleNamespace(hash=mix(words[at[lo]:at[hi]].astype(U)))
                head, tail = at[lo:hi] - at[lo], at[lo + 1:hi + 1] - at[lo]
                of, key = _segments(w, head, tail)
                long, parity = _parities(w, head, tail)
                maps = np.zeros((hi - lo, BITS // 64), U)
                maps[long] = parity
                found = np.zeros(len(key), RECORD)
                found["key"], found["bits"], found["n"] = key, maps[of], (tail - head)[of]
                found["content"], found["high"], found["low"] = content.view(U)[lo + of], high[lo + of], low[lo + of]
                out.append(found)
                lo = hi
            if out:
                found = np.concatenate(out)
                yield from _packed(_dealt(0, found["key"] >> U(64 - bits), found))

    return lines.select("content", "doc_id", "line", "n", "tokens").mapInArrow(run, PACKED)


def _groups(records: DataFrame) -> DataFrame:
    """Keys' lines by their places, of keys that several lines have, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _each_bucket(batches):
            found = _joined(rows, 0, RECORD)
            found = found[np.lexsort((found["low"], found["high"], found["key"]))]
            start, size = _runs(found["key"])
            found = found[np.repeat(size > 1, size)]
            if len(found):
                yield from _packed([(bucket, 0, found)])

    return _by_bucket(records).mapInArrow(run, PACKED)


def _allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines ``y`` come before lines ``x`` (RECORD), and lengths and parity maps don't exclude the allowed edits."""
    edits = np.minimum(x["n"], y["n"]) // EDIT_WORDS
    good = (np.abs(x["n"] - y["n"]) <= edits) & ((y["high"] < x["high"]) | (y["high"] == x["high"]) & (y["low"] < x["low"]))
    at = np.flatnonzero(good)
    good[at] = np.bitwise_count(x["bits"][at] ^ y["bits"][at]).sum(axis=1, dtype=np.int64) <= 2 * edits[at]
    return good


def _leading(found: np.ndarray) -> np.ndarray:
    """(content, before) of the lines of a bucket that a key's earliest line may exclude."""
    start, size = _runs(found["key"])
    first = np.repeat(start, size)
    at = np.flatnonzero(first != np.arange(len(found)))
    at = at[_allowed(found[at], found[first[at]])]
    return np.stack([found["content"][at], found["content"][first[at]]], axis=1)


def _earlier(found: np.ndarray, held: tuple[int, int, np.ndarray]) -> Iterator[np.ndarray]:
    """(content, before) of the lines of a bucket that a map holds, with each earlier line of a key but its first."""
    start, size = _runs(found["key"])
    first = np.repeat(start, size)
    stay = np.flatnonzero(_is_in(found["content"], held) & (np.arange(len(found)) > first + 1))
    much = np.concatenate([[0], np.cumsum(stay - first[stay] - 1)])
    lo = 0
    while lo < len(stay):
        hi = max(lo + 1, int(np.searchsorted(much, much[lo] + PAIRS, side="right")) - 1)
        size = np.diff(much[lo:hi + 1])
        x = np.repeat(stay[lo:hi], size)
        y = np.repeat(first[stay[lo:hi]] + 1, size) + np.arange(len(x)) - np.repeat(much[lo:hi] - much[lo], size)
        good = _allowed(found[x], found[y])
        yield np.stack([found["content"][x[good]], found["content"][y[good]]], axis=1)
        lo = hi


def _candidates(groups: DataFrame, bits: int, pairs_of) -> DataFrame:
    """Different (content, before) of the pairs that a function finds in a bucket's lines."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                pairs = [x for x in pairs_of(np.frombuffer(data, RECORD)) if len(x)]
                if pairs:
                    pairs = np.unique(np.concatenate(pairs), axis=0)
                    yield from _packed(_dealt(0, mix(pairs[:, 0]) >> U(64 - bits), pairs))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _each_bucket(batches):
            pairs = np.unique(_joined(rows, 0, U).reshape(-1, 2), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["content", "before"])

    return _by_bucket(groups.mapInArrow(find, PACKED)).mapInArrow(once, "content long, before long")


def _compared(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(content) of the pairs (content, before) within the allowed edits."""
    tokens = lines.select("content", "tokens")
    pairs = candidates.join(tokens, "content").join(tokens.select(F.col("content").alias("before"), F.col("tokens").alias("other")), "before")
    return _verified(pairs).distinct()


def _gone_long(lines: DataFrame, bits: int, few: int) -> DataFrame:
    """(content) of longer lines that are near an earlier one."""
    groups = materialize(_groups(_records(lines, bits)), "groups")
    near = materialize(_candidates(groups, bits, lambda found: [_leading(found)]), "nearest")
    gone = materialize(_compared(near, lines), "gone")
    stays = materialize(_idents(lines.join(gone, "content", "left_anti"), few), "stays")
    held = lines.sparkSession.sparkContext.broadcast(_map(stays, few))
    rest = _candidates(groups, bits, lambda found: _earlier(found, held.value))
    rest = materialize(rest.join(near, ["content", "before"], "left_anti").join(gone, "content", "left_anti"), "rest")
    return gone.union(_compared(rest, lines))


def _gone_short(lines: DataFrame) -> DataFrame:
    """(content) of lines that are within one edit of an earlier one."""
    keys = variants(lines)
    first = keys.groupBy("key").agg(F.min("place").alias("any"), F.min(F.when(F.col("whole"), F.col("place"))).alias("line"), F.count("*").alias("n")).where("n > 1")
    earlier = keys.join(first, "key").select("content", "place", F.when(F.col("whole"), F.col("any")).otherwise(F.col("line")).alias("earliest"))
    earlier = earlier.where("earliest < place").groupBy("content").agg(F.min("earliest").alias("earliest"))
    return _verified(lines.join(earlier, "content").join(lines.select(F.col("place").alias("earliest"), F.col("tokens").alias("other")), "earliest"))


def _unpacked(met: DataFrame, kind: int, dtype, schema: str, optional: str = "") -> DataFrame:
    """Rows of one kind; ``optional`` is null where ``known`` is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _joined([(kind, x) for x in batch.column("data").to_pylist()], kind, dtype)
            names = [c for c in dtype.names if c != "known"]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]), mask=rows["known"] == 0 if c == optional else None) for c in names], names=names)

    return met.where(F.col("kind") == kind).mapInArrow(run, schema)


def _place(doc_id: str = "doc_id", line: str = "line") -> Column:
    """Order of a line as one number: by document, then line; null keys last."""
    return F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)")).cast("decimal(38,0)") * F.lit(
        "4294967296").cast("decimal(10,0)") + F.col(line).cast("decimal(10,0)")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``row`` (an own number), doc_id, ``tag`` (hash of
    the text), ``n_lines`` (lines with a word), ``n_equal`` and ``n_near``
    (removed lines that equal an earlier one, and others) and ``removed`` (line
    numbers).

    A line is a part between line feeds; its words are compared. It goes if an
    earlier line, by doc_id and then line number, is equal, or both have
    MIN_WORDS words or more and are within one word edit for each EDIT_WORDS words of
    the shorter one, or within one at least; whether that line stays itself
    doesn't matter.

    Null texts have no lines; null keys come last; lines at one place (repeated
    rows) don't remove each other; an empty table gives an empty result; other
    columns are ignored. Texts are read twice. First, all segments of longer lines and
    the halves of others are counted by hash, which leaves the lines with as many of them
    in other lines as a near line would have: no pair within the edits is lost. Then the
    words of these are read. Lines of up to 2 * EDIT_WORDS words emit
    variants. A variant's earliest lines are found with partial minima, so no pairs of a
    crowded variant are listed: the earliest line with it is enough to remove all
    others. Longer lines are compared with the earliest lines of their
    segments, and what then stays with every earlier line of a segment
    that lengths and parity maps allow.
    """
    own = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text))).alias("tag"), F.col(quoted(text)).alias("text"))
    bits, few = _buckets(docs, 15), _buckets(docs, 10)
    met = materialize(_met(_scanned(own, bits, few), few), "met")
    held = docs.sparkSession.sparkContext.broadcast(_map(materialize(_left(met), "left"), few))
    copies = materialize(_tokens(own, held), "copies").withColumn("place", _place().cast("decimal(38,0)"))
    lines = copies.groupBy("content").agg(F.min(F.struct("place", "doc_id", "line", "n", "tokens")).alias("first")).select("content", "first.*")
    lines = materialize(lines, "words")
    gone = _gone_short(lines.where(F.col("n") <= 2 * EDIT_WORDS)).union(_gone_long(lines.where(F.col("n") >= 2 * EDIT_WORDS), bits, few)).distinct()

    rows = _unpacked(met, DOCS, DOC, "row long, doc_id long, tag long, n_lines long", "doc_id")
    at = copies.join(lines.join(gone, "content").select("content", "place"), ["content", "place"]).select(F.col("doc_id").alias("own"), F.col("tag").alias("of"), "line").distinct()
    near = rows.join(at, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("tag") == F.col("of"))).select("row", "line", F.lit(True).alias("near"))
    equal = _unpacked(met, EQUAL, GONE, "row long, line long").select("row", F.col("line").cast("int").alias("line"), F.lit(False).alias("near"))
    removed = near.union(equal).groupBy("row").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list("line")).alias("removed"))
    none = F.array().cast("array<int>")
    return rows.join(removed, "row", "left").select(
        "row", "doc_id", "tag", "n_lines", F.coalesce("n_equal", F.lit(0).cast("long")).alias("n_equal"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("removed", none).alias("removed"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines of repeated(); other columns pass through."""
    aside, back = set_aside(docs)
    at = docs.columns.index(text)
    gone = repeated(docs, key, text).select(F.col("doc_id").alias("key"), "tag", "removed").distinct()
    rows = docs.select(*aside, F.col(quoted(key)).cast("long").alias("own"), F.xxhash64(F.col(quoted(text))).alias("hash"))
    rows = rows.join(gone, F.col("own").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("tag")), "left")
    parts = F.split(F.col(f"in{at}"), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("removed", i)), "\n")
    return rows.withColumn(f"in{at}", F.when(F.size("removed") > 0, kept).otherwise(F.col(f"in{at}"))).select(*back)
