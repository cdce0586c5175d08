"""Periodic runs of words, found on a grammar.

Re-Pair replaces the most frequent pairs of neighbouring symbols by
nonterminals, round by round. A run lies in a lowest node of the derivation and
crosses the boundary between that node's two halves, so it is enough to look
at the boundary of each different nonterminal once; what is found there is
translated to all positions that derive from it, and of the intervals of one
period only the maximal ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.text import U, _BASE, _powers, each_chunk, mix

LEAST = 6       # words of a run
EXPONENT = 4    # periods of a run
SLICE = 1 << 18  # boundary and period combinations looked at together
STOP = 64       # a round that replaces fewer than a STOPth of the symbols is the last by frequency

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _frequent(key: np.ndarray, same: np.ndarray) -> np.ndarray:
    """First symbols of the pairs to replace: pairs that stand there twice or more
    and more often than the pairs that they overlap. ``key``: each symbol's pair with
    the next one; ``same``: whether that is in the same text. Of equal pairs that
    overlap (a a a) every second one is taken."""
    at = np.flatnonzero(same)
    if not len(at):
        return at
    _, of, count = np.unique(key[at], return_inverse=True, return_counts=True)
    rank = count[of] * len(count) + of
    touch = np.diff(at) == 1
    head = np.flatnonzero(np.concatenate([[True], ~touch | (of[1:] != of[:-1])]))
    size = np.diff(np.append(head, len(at)))
    own = rank[head]
    near = touch[head[1:] - 1]  # whether a stretch of equal pairs overlaps the one before
    before = np.concatenate([[-1], np.where(near, own[:-1], -1)])
    after = np.concatenate([np.where(near, own[1:], -1), [-1]])
    taken = (count[of[head]] > 1) & (own > before) & (own > after)
    offset = np.arange(len(at)) - np.repeat(head, size)
    return at[np.repeat(taken, size) & (offset % 2 == 0)]


def grammar(symbol: np.ndarray, row: np.ndarray):
    """Derivation of consecutive texts, ``symbol`` their words and ``row`` their
    numbers: for each replaced pair its nonterminal, first word, words of the left
    half and words. Where no pair is frequent any more, neighbours are paired until
    one symbol is left of each text, so that every boundary has a node."""
    at, size = np.arange(len(symbol)), np.ones(len(symbol), np.int64)
    nodes, forced = [], False
    while len(symbol) > 1:
        same = np.append(row[1:] == row[:-1], False)
        if not same.any():
            break
        key = mix(symbol * U(0xD6E8FEB86659FD93) + mix(np.append(symbol[1:], U(0))))
        if not forced:
            left = _frequent(key, same)
            forced = len(left) * STOP < len(symbol)
        if forced:
            first = np.searchsorted(row, row)
            left = np.flatnonzero(same & ((np.arange(len(row)) - first) % 2 == 0))
        nodes.append((key[left], at[left], size[left], size[left] + size[left + 1]))
        symbol, size = symbol.copy(), size.copy()
        symbol[left], size[left] = key[left], size[left] + size[left + 1]
        stay = np.ones(len(symbol), bool)
        stay[left + 1] = False
        symbol, at, size, row = symbol[stay], at[stay], size[stay], row[stay]
    if not nodes:
        return np.zeros(0, U), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*nodes))


class Sums:
    """Prefix sums of word hashes; equal stretches of words compare equal."""

    def __init__(self, hashes: np.ndarray):
        self.power = _powers(_BASE, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * self.power[:len(hashes)], dtype=U, out=self.total[1:])

    def equal(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` and from ``a + q`` are the same."""
        t = self.total
        return (t[a + n] - t[a]) * self.power[q] == t[a + q + n] - t[a + q]

    def reach(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words after ``a`` (before it, if ``back``), up to ``most``,
        that are the same ``q`` words further on."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while len(a) and (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.equal(a - middle if back else a, q, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _at_boundaries(words: np.ndarray, sums: Sums, first, left, size):
    """(node, start, end, period) of the runs at the boundary of each node, within
    it. Of a run of four periods or more, two at least lie on one side of the
    boundary: there the word after (before) the boundary starts (ends) a square."""
    found = []
    for back in (False, True):
        half = left if back else size - left
        most = np.minimum(size // EXPONENT, half // 2)
        upto = np.concatenate([[0], np.cumsum(most)])
        for lo in range(0, int(upto[-1]), SLICE):
            flat = np.arange(lo, min(lo + SLICE, int(upto[-1])))
            node = np.searchsorted(upto, flat, side="right") - 1
            q = flat - upto[node] + 1
            a = first[node] + left[node] - (2 * q if back else 0)
            may = (words[a] == words[a + q]) & (words[a + q - 1] == words[a + 2 * q - 1])
            node, q, a = node[may], q[may], a[may]
            may = sums.equal(a, q, q)
            node, q, a = node[may], q[may], a[may]
            end = first[node] + size[node]
            s = a - sums.reach(a, q, a - first[node], True)
            e = a + q + sums.reach(a, q, end - a - q, False)
            long = e - s >= np.maximum(LEAST, EXPONENT * q)
            found.append((node[long], s[long], e[long], q[long]))
    node, s, e, q = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    # a period's multiples give the same interval
    order = np.lexsort((q, e, s, node))
    node, s, e, q = node[order], s[order], e[order], q[order]
    new = np.append(True, (np.diff(node) != 0) | (np.diff(s) != 0) | (np.diff(e) != 0))[:len(node)]
    return node[new], s[new], e[new], q[new]


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """The intervals that none of the same period contains, each with the least
    period, by start and period. An interval that ends with its node is contained
    in the one that a higher node finds."""
    order = np.lexsort((-end, start, period))
    s, e, q = start[order], end[order], period[order]
    if not len(s):
        return s, e, q
    _, group = np.unique(q, return_inverse=True)
    ends = e + group * (int(e.max()) + 1)
    over = np.maximum.accumulate(ends)
    stay = np.append(True, ends[1:] > over[:-1])
    s, e, q = s[stay], e[stay], q[stay]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.append(True, (np.diff(s) != 0) | (np.diff(e) != 0))
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def find(words: np.ndarray, row: np.ndarray):
    """(start, end, period) of all runs of consecutive texts' words."""
    symbol, at, left, size = grammar(words, row)
    wide = size >= LEAST
    symbol, at, left, size = symbol[wide], at[wide], left[wide], size[wide]
    _, one, kind = np.unique(symbol, return_index=True, return_inverse=True)
    node, s, e, q = _at_boundaries(words, Sums(words), at[one], left[one], size[one])
    # to all positions that derive from the node
    order = np.argsort(kind, kind="stable")
    places = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(one)))])
    times = np.diff(places)[node]
    run = np.repeat(np.arange(len(node)), times)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    shift = at[order][places[node[run]] + nth] - at[one][node[run]]
    s, e, q = maximal(s[run] + shift, e[run] + shift, q[run])
    # word hashes were compared by sums: hold the runs against the words themselves
    true = [bool((words[a:b - p] == words[a + p:b]).all()) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist())]
    return s[true], e[true], q[true]


def _joined(w, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by single spaces."""
    data, inside = w.data.copy(), np.zeros(len(w.data) + 1, np.int32)
    np.add.at(inside, w.start[keep], 1)
    np.add.at(inside, w.end[keep], -1)
    mask = np.cumsum(inside[:-1]) > 0
    kept = np.flatnonzero(keep)
    inner = kept[:-1][w.row[kept[:-1]] == w.row[kept[1:]]]  # a word that another one of its row follows
    data[w.end[inner]] = 32
    mask[w.end[inner]] = True
    total = np.concatenate([[0], np.cumsum(mask)])
    return pa.Array.from_buffers(pa.string(), len(w.offsets) - 1, [None, pa.py_buffer(total[w.offsets].astype(np.int32)), pa.py_buffer(data[mask])])


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``runs`` (an array of (start,
    length, period) in words, by start and period) and ``collapsed``, the text's
    words without those of a run after its first period, joined by single spaces.

    A run is a stretch of words with smallest period q, of ``LEAST`` words and of
    ``EXPONENT`` periods at least, that neither neighbouring word extends. Words are
    runs of other than white space, compared as they are. A null or empty text has
    no words and no runs and collapses to an empty text; repeated rows stay; an
    empty table gives an empty result; other columns pass through, those named like
    added ones are replaced.

    Each text is worked on as a whole, in chunks of bounded size or one longer
    text; texts of one chunk share their grammar. Nothing is shuffled. Words are
    told apart by 64-bit hashes.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    gone = {f.name for f in added} | {text.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    at = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in gone]
    body = next(i for i, f in enumerate(docs.schema.fields) if f.name.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(body)], names=["text"])
            for lo, hi, w in each_chunk(texts):
                s, e, q = find(w.hash, w.row)
                of = w.row[s]
                steps = np.zeros(len(w) + 1, np.int64)
                np.add.at(steps, s + q, 1)
                np.add.at(steps, e, -1)
                keep = np.cumsum(steps[:-1]) == 0
                fields = [pa.array(x.astype(np.int64)) for x in (s - w.first[of], e - s, q)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(lo, hi - lo) for i in at], pa.array(np.diff(w.first).astype(np.int64)), found, _joined(w, keep)],
                    names=[*names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))
