"""Benchmark decontamination with SimHash windows.

Windows as long as each benchmark item are fingerprinted by SimHash over
weighted five-word shingles. Fingerprints are split into blocks; two within
the radius must agree in one block up to radius // blocks bits (the pigeonhole
of multi-index Hamming search), so a table of near block values finds every
pair within the radius. The exact weighted similarity of the shingles then
verifies the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U, each_chunk, grams, mix, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19          # of 64 bits; windows of similarity 0.8 differ in 10 bits on average, so 3 deviations more
BLOCKS = 4           # of 16 bits
ITEMS_BYTES = 4 << 20  # benchmark text per broadcast index; a larger benchmark is matched in several
WINDOWS = 20_000     # windows fingerprinted at a time

MATCHES = "item_id long, similarity double, from_word long, n_words long"


def fold() -> np.ndarray:
    """Shingles ignore ASCII case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    """The 64 signs of each shingle, as -1 and 1."""
    bits = np.unpackbits(mix(hashes ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as BLOCKS 16-bit numbers, of weighted sums of signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(len(sums), BLOCKS)


class Index:
    """A bounded set of benchmark items: their shingles, weights, fingerprints
    and the table of near block values. ``n`` items are in the whole benchmark;
    ``repeated`` are its shingles that ``held`` items, two or more, hold."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, repeated: np.ndarray, held: np.ndarray):
        self.ids, self.sizes, shingles = [], [], []
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            w = words(data, np.array([0, len(data)]), fold())
            # an item of under five words is one shingle of all its words
            own = grams(w.hash, min(SHINGLE, len(w))) if len(w) else np.zeros(0, U)
            if len(own):
                self.ids.append(item)
                self.sizes.append(len(w))
                shingles.append(own)
        self.n = len(self.ids)
        self.sizes = np.array(self.sizes, np.int64)
        self.short = [(i, shingles[i][0]) for i in range(self.n) if self.sizes[i] < SHINGLE]
        every = np.unique(np.concatenate([np.zeros(0, U), *shingles]))
        self.shingles = every
        # shingle weights: what few items of all hold counts for more
        self.repeated, self.weights = repeated, 1.0 + np.log(max(n, 1) / held)
        self.single = 1.0 + np.log(max(n, 1))  # of a shingle in no item too
        self.vectors, prints = [], []
        for own in shingles:
            key, count = np.unique(own, return_counts=True)
            self.vectors.append((key, count, float((count * self.weight(key)).sum())))
            prints.append((shingle_bits(own) * self.weight(own)[:, None]).sum(axis=0))
        self.prints = simhash(np.array(prints).reshape(self.n, 64)) if self.n else np.zeros((0, BLOCKS), np.uint16)
        self.member = np.zeros(1 << 22, bool)
        self.member[(every & U((1 << 22) - 1)).astype(np.int64)] = True

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.repeated):
            return np.full(len(hashes), self.single)
        at = np.minimum(np.searchsorted(self.repeated, hashes), len(self.repeated) - 1)
        return np.where(self.repeated[at] == hashes, self.weights[at], self.single)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that an item holds."""
        maybe = np.flatnonzero(self.member[(hashes & U((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
        return maybe[self.shingles[at] == hashes[maybe]]

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within RADIUS, for items of ``size`` words. A block's
        lookup by value is its row of ``table``: the items whose block is within
        RADIUS // BLOCKS bits of it."""
        items = np.flatnonzero(self.sizes == size)
        hit = np.zeros((len(prints), len(items)), bool)
        for b in range(BLOCKS):
            values, inverse = np.unique(prints[:, b], return_inverse=True)
            table = np.bitwise_count(values[:, None] ^ self.prints[items, b][None, :]) <= RADIUS // BLOCKS
            hit |= table[inverse]
        window, item = np.nonzero(hit)
        item = items[item]
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        return window[apart <= RADIUS], item[apart <= RADIUS]

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's and a window's shingles."""
        key, count, total = self.vectors[item]
        own, times = np.unique(hashes, return_counts=True)
        both, a, b = np.intersect1d(key, own, assume_unique=True, return_indices=True)
        shared = float((np.minimum(count[a], times[b]) * self.weight(both)).sum())
        return shared / (total + float((times * self.weight(own)).sum()) - shared)

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Best window (item, similarity, first word, words) of each item that
        one document's words contain."""
        best: dict[int, tuple[float, int]] = {}
        n = len(hashes)
        for size, want in {(int(self.sizes[i]), h) for i, h in self.short}:
            got = np.flatnonzero(grams(hashes, size) == want)
            for i, h in self.short:
                if len(got) and h == want and self.sizes[i] == size:
                    best[i] = (1.0, int(got[0]))
        own = grams(hashes, SHINGLE)
        known = self.known(own)
        if len(known):
            sizes = np.unique(self.sizes[self.sizes >= SHINGLE])
            # a document shorter than an item is one window for it
            for size in sizes.tolist():
                width = min(size, n) - SHINGLE + 1
                starts = np.unique((known[:, None] - np.arange(width)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + width <= len(own))]
                for at in range(0, len(starts), WINDOWS):
                    self._windows(size, width, own, starts[at:at + WINDOWS], best)
        return [(self.ids[i], s, at, int(min(self.sizes[i], n))) for i, (s, at) in sorted(best.items())]

    def _windows(self, size, width, own, starts, best):
        # runs of shingles that the windows touch, one after the other
        edges = np.flatnonzero(np.diff(starts, prepend=starts[0] - width - 1) > width)
        for lo, hi in zip(edges, np.append(edges[1:], len(starts))):
            first, last = int(starts[lo]), int(starts[hi - 1]) + width
            part = own[first:last]
            total = np.zeros((len(part) + 1, 64), np.float32)
            np.cumsum(shingle_bits(part) * self.weight(part).astype(np.float32)[:, None], axis=0, out=total[1:])
            at = starts[lo:hi] - first
            window, item = self.near(size, simhash(total[at + width] - total[at]))
            for w, i in zip(window.tolist(), item.tolist()):
                s = self.similarity(i, part[at[w]:at[w] + width])
                if s >= SIMILARITY and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (s, int(starts[lo + w]))


def _held(items: DataFrame, key: str, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of items with a word in the whole benchmark, and its shingles that
    two items or more hold, in order, with the number of these items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in each_chunk(batch, "text", fold()):
                sizes = np.diff(w.first)
                own = [np.unique(grams(w.hash[w.first[r]:w.first[r + 1]], min(SHINGLE, sizes[r]))) for r in np.flatnonzero(sizes)]
                # a row without a shingle for each item
                values = pa.array(np.concatenate([*own, np.zeros(len(own), U)]).view(np.int64))
                single = pa.array(np.arange(len(values)) >= len(values) - len(own))
                yield pa.RecordBatch.from_arrays([values, single], names=["shingle", "item"])

    different = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    held = different.select("text").mapInArrow(run, "shingle long, item boolean").groupBy("shingle", "item").agg(F.count("*").alias("n"))
    rows = held.where("item or n > 1").toArrow()
    item, shingle, n = (rows.column(c).to_numpy() for c in ("item", "shingle", "n"))
    item = item.astype(bool)
    order = np.argsort(shingle[~item].view(U))
    return int(n[item].sum()), shingle[~item].view(U)[order], n[~item][order].astype(np.int64)


def _blocks(items: DataFrame, key: str, text: str) -> list[list[tuple[int, bytes]]]:
    """All items in blocks of at most ITEMS_BYTES or one item."""
    out, part, size = [], [], 0
    for row in items.select(F.col(key).cast("long"), text).where(F.col(text).isNotNull()).distinct().orderBy(key, text).toLocalIterator():
        raw = row[1].encode()
        if part and size + len(raw) > ITEMS_BYTES:
            out.append(part)
            part, size = [], 0
        part.append((row[0], raw))
        size += len(raw)
    return [*out, part] if part else out


def matched(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, similarity, from_word,
    n_words), the best window of each benchmark item whose weighted similarity
    with the document's window of the item's size is SIMILARITY or more.

    Words are runs of other than white space, shingles are SHINGLE of them in a
    row without regard to ASCII case; an item or document of fewer words is
    matched as one shingle. Windows start at every word. Those that share no
    shingle with an item have similarity 0 with all and aren't fingerprinted.

    Null and empty texts match nothing, on either side; repeated rows stay;
    repeated item ids are separate items; empty tables give empty results;
    other columns pass through, one named ``leaks`` is replaced. The documents
    are read once and not shuffled. The benchmark is a stated set: it is read in
    blocks of bounded size, each broadcast on its own. Shingles are weighted by all
    items, so results do not depend on the blocks; the shingles that several items
    hold are broadcast once.
    """
    rows = docs.drop("leaks") if "leaks" in [c.lower() for c in docs.columns] else docs
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("from_word", pa.int64()), ("n_words", pa.int64())]))
    fields = ", ".join(x.replace(" ", ":") for x in MATCHES.split(", "))
    empty = f"array<struct<{fields}>>"
    result = rows.withColumn("leaks", F.array().cast(empty))
    blocks = _blocks(items, item_key, item_text)
    counts = docs.sparkSession.sparkContext.broadcast(_held(items, item_key, item_text)) if blocks else None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, *counts.value)
            for batch in batches:
                before = batch.column("leaks").to_pylist()
                leaks = []
                for lo, hi, w in each_chunk(batch, text, fold()):
                    own = grams(w.hash, SHINGLE)
                    hot = np.unique(w.row[index.known(own)]) if not index.short else np.arange(hi - lo)
                    found = {int(r): index.matches(w.hash[w.first[r]:w.first[r + 1]]) for r in hot}
                    leaks += [(before[lo + r] or []) + [dict(zip(kind.value_type.names, x)) for x in found.get(r, ())] for r in range(hi - lo)]
                at = batch.schema.get_field_index("leaks")
                yield batch.set_column(at, pa.field("leaks", kind), pa.array(leaks, kind))

        result = result.mapInArrow(run, result.schema)
    return result
