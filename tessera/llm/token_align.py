"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by both tokenizers. The ends of their tokens are two
ascending lists; a galloping search of the longer for the ends of the shorter
gives the common ends, which cut the tokens into groups, and the differences of
ranks, which give the tokens that each token overlaps. How often two ids overlap
is counted over the documents of the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import quoted, set_aside
from tessera.llm.text import chunks, range_hashes, utf8
from tessera.session import materialize

BLOCK = 1 << 20      # bytes of text that share a dictionary of pairs
STRIDES = (4096, 256, 32, 4, 1)  # a search starts where the nearest end of the stride before was found
LONG = 1000          # bytes of a stretch that is encoded on its own
TOGETHER = 8         # shorter stretches that B encodes as one text
KNOWN = 1 << 20      # tokens of stretches that a task remembers, then it starts anew

NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@dataclass
class Files:
    """The two vocabularies, as read by the driver: a byte-level BPE for the
    ``tokenizers`` library and a ``sentencepiece`` model."""

    a: str
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Files:
        with open(a, encoding="utf-8") as fa, open(b, "rb") as fb:
            return Files(fa.read(), fb.read())

    def b_size(self) -> int:
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=self.b).get_piece_size()


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


#: How a ByteLevel pre-tokenizer splits (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """The bytes of every id of one tokenizer."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def gives(self, ids: np.ndarray, data: np.ndarray) -> bool:
        size = self.size[ids]
        return int(size.sum()) == len(data) and bool((self.data[spread(self.start[ids], size)] == data).all())


class Both:
    """Both tokenizers."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        letters = byte_letters()
        added = {x["content"]: x["id"] for x in json.loads(files.a).get("added_tokens") or []}
        vocabulary = {e: i for e, i in self.a.get_vocab(with_added_tokens=True).items()}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = entry.encode() if entry in added else bytes(letters[c] for c in entry)
        self.of_a, self.of_b = Side(entries), Side([piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])
        # a space after other than white space starts a token in both, so texts can be
        # encoded in stretches that end there
        split = json.loads(files.a).get("pre_tokenizer") or {}
        self.apart = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                      and not any(b" " in x.lstrip(b" ") for x in self.of_b.entries))
        self.closing = np.ones(256, bool)  # bytes that can't end white space of any script
        self.closing[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
        # ids in the order of merges are ranks: then tiktoken merges the same way
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in json.loads(files.a)["model"].get("merges", [])]
        ranks = {bytes(letters[c] for c in e): i for e, i in vocabulary.items() if e not in added}
        self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if self.apart and merged == sorted(merged) else None
        self.dot = self.b.encode(".")
        self.forget()
        self.names = Side([b"%d," % i for i in range(max(len(self.of_a.entries), len(self.of_b.entries)))])

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the stretches: all texts', and where ``apart`` holds, spaces after
        a closing byte."""
        start = np.zeros(len(data), bool)
        if self.apart and len(data):
            start[1:] = (data[1:] == 32) & self.closing[data[:-1]]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Tokens of stretches that each start with a space: for A and B the ids and
        how many each stretch has; and whether both give the stretch's bytes back.
        Short stretches are encoded many at a time."""
        size = end - start
        mark = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            np.cumsum((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81), out=mark[1:-2])
            mark[-2:] = mark[-3]
        many = (size <= LONG) & self.closing[data[end - 1]] & (mark[end] == mark[start]) & (self.quick is not None)
        at = np.flatnonzero(many)
        joined = data[spread(start[at], size[at])]
        ends, sides = np.cumsum(size[at]), None
        if len(at):
            raw = joined.tobytes()
            cut = [0, *ends[TOGETHER - 1::TOGETHER].tolist(), len(raw)]
            a = np.array(self.quick.encode_ordinary(raw.decode()), np.int64)
            parts = [raw[x + 1:y].decode() for x, y in zip(cut, cut[1:]) if x < y]
            b = np.array([i for x in self.b.encode(parts, num_threads=1) for i in x], np.int64)
            if self.of_a.gives(a, joined) and self.of_b.gives(b, joined):
                sides = [(ids, np.diff(np.searchsorted(np.cumsum(of.size[ids]), ends) + 1, prepend=0)) for ids, of in ((a, self.of_a), (b, self.of_b))]
        if sides is None:
            many, at, sides = np.zeros(len(size), bool), at[:0], [(np.zeros(0, np.int64),) * 2] * 2
        rest = np.flatnonzero(~many)
        texts = [data[s:e].tobytes() for s, e in zip(start[rest].tolist(), end[rest].tolist())]
        plain = [t.decode() for t in texts]
        # B adds the first space itself, but none to an empty text
        ids_b = self.b.encode([t[1:] if t.strip(" ") else "." + t for t in plain], num_threads=1)
        ids_b = [x if t.strip(" ") else x[len(self.dot):] for t, x in zip(plain, ids_b)]
        ids_a = [x.ids for x in self.a.encode_batch(plain, add_special_tokens=False)]
        same = np.ones(len(size), bool)
        for r, t, x, y in zip(rest.tolist(), texts, ids_a, ids_b):
            same[r] = b"".join([self.of_a.entries[i] for i in x]) == t == b"".join([self.of_b.entries[i] for i in y])
        out = []
        for (ids, count), others in zip(sides, (ids_a, ids_b)):
            flat = np.concatenate([ids, np.array([i for x in others for i in x], np.int64)])
            number = np.zeros(len(size), np.int64)
            number[at], number[rest] = count, [len(x) for x in others]
            first = np.zeros(len(size), np.int64)
            order = np.concatenate([at, rest])
            first[order] = np.cumsum(number[order]) - number[order]
            out += [flat, first, number]
        return *out, same

    def forget(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.known = [np.zeros(0, np.int64)] * 2, np.zeros((5, 0), np.int64)

    def look_up(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """As ``encode``, but of different stretches that it knows from before by their
        hash."""
        if len(self.flat[0]) > KNOWN:
            self.forget()
        at = np.minimum(np.searchsorted(self.hash, hashes), max(len(self.hash) - 1, 0))
        new = self.hash[at] != hashes if len(self.hash) else np.ones(len(hashes), bool)
        flat_a, first_a, count_a, flat_b, first_b, count_b, same = self.encode(data, start[new], end[new])
        rows = np.array([first_a + len(self.flat[0]), count_a, first_b + len(self.flat[1]), count_b, same])
        self.hash, self.place = np.append(self.hash, hashes[new]), np.append(self.place, self.known.shape[1] + np.arange(len(same)))
        self.flat, self.known = [np.append(self.flat[0], flat_a), np.append(self.flat[1], flat_b)], np.hstack([self.known, rows])
        order = np.argsort(self.hash)
        self.hash, self.place = self.hash[order], self.place[order]
        first_a, count_a, first_b, count_b, same = self.known[:, self.place[np.searchsorted(self.hash, hashes)]]
        return self.flat[0], first_a, count_a, self.flat[1], first_b, count_b, same.astype(bool)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``start``, ``count`` of them, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - start, count)


def gallop(drive: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of ``drive``'s ends the first position in ``other`` whose end is
    not smaller. Steps double from where the search starts until they pass the end,
    then halve. All ends of a stride are searched side by side, each from where the
    nearest one before it of the stride above was found."""
    low = np.zeros(len(drive), np.int64)
    above = 0
    for stride in STRIDES:
        at = np.arange(0, len(drive), stride)
        begin = low[at // above * above] if above else np.zeros(len(at), np.int64)
        low[at], above = _search(drive[at], other, begin), stride
    return low


def _search(wanted: np.ndarray, other: np.ndarray, low: np.ndarray) -> np.ndarray:
    high = low.copy()
    going, step = np.arange(len(wanted)), 1
    while len(going):
        probe = low[going] + step - 1
        under = (probe < len(other)) & (other[np.minimum(probe, len(other) - 1)] < wanted[going])
        high[going[~under]] = np.minimum(probe[~under], len(other))
        going = going[under]
        low[going] = probe[under] + 1
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        under = other[middle] < wanted[going]
        low[going[under]] = middle[under] + 1
        high[going[~under]] = middle[~under]
        going = going[low[going] < high[going]]
    return low


def written(names: Side, a, b, a_group, b_group, a_last, b_last) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;...``: the bytes, and where each token of either
    side starts in them, in the order of the text. ``names``: each id and a comma."""
    b_first = np.concatenate([[0], np.flatnonzero(b_last) + 1])
    a_end = np.flatnonzero(a_last) + 1
    ids, last = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    a_at = np.arange(len(a)) + b_first[a_group]
    b_at = np.arange(len(b)) + a_end[b_group] if len(b) else np.zeros(0, np.int64)
    ids[a_at], ids[b_at] = a, b
    last[a_at] = np.where(a_last, ord("|"), ord(","))
    last[b_at] = np.where(b_last, ord(";"), ord(","))
    size = names.size[ids]
    begin = np.concatenate([[0], np.cumsum(size)])
    out = names.data[spread(names.start[ids], size)]
    out[begin[1:] - 1] = last
    return out, begin


def align(both: Both, a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, rows: int):
    """Groups and links of ``rows`` texts' tokens ``a`` and ``b``, in order;
    ``a_of``, ``b_of``: their texts. All texts have as many bytes by either. Returns (groups per row, digest of the groups per row,
    row, A id and B id of each link)."""
    n_a, n_b = np.bincount(a_of, minlength=rows), np.bincount(b_of, minlength=rows)
    groups, digests = np.zeros(rows, np.int64), [""] * rows
    links = []
    for a_drives in (True, False):
        mine = (n_a > 0) & ((n_a <= n_b) == a_drives)
        x, y = np.flatnonzero(mine[a_of]), np.flatnonzero(mine[b_of])
        if not len(x):
            continue
        ends = [np.cumsum(both.of_a.size[a[x]]), np.cumsum(both.of_b.size[b[y]])]
        drive, other = ends if a_drives else ends[::-1]
        low = gallop(drive, other)
        common = other[low] == drive
        met = np.zeros(len(other), bool)
        met[low[common]] = True
        # a token overlaps the other side's from the first that ends after its start
        first = np.concatenate([[0], (low + common)[:-1]])
        count = low - first + 1
        here, there = np.repeat(np.arange(len(drive)), count), spread(first, count)
        i, j = (here, there) if a_drives else (there, here)
        links.append((a_of[x[i]], a[x[i]], b[y[j]]))
        a_last, b_last = (common, met) if a_drives else (met, common)
        groups += np.bincount(a_of[x[a_last]], minlength=rows)
        text, begin = written(both.names, a[x], b[y], np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last, a_last, b_last)
        ends = begin[np.cumsum((n_a + n_b) * mine)]
        at = 0
        for r in np.flatnonzero(mine).tolist():
            digests[r] = hashlib.sha256(text[at:ends[r] - 1].tobytes()).hexdigest()
            at = ends[r]
    empty = np.zeros(0, np.int64)
    return groups, digests, *(np.concatenate(z) if links else empty for z in (zip(*links) if links else [()] * 3))


def _tokens(both: Both, data: np.ndarray, offsets: np.ndarray):
    """Ids of A and B of consecutive texts that start with a space, and the texts
    that they belong to; no ids where the bytes don't come back."""
    start = both.stretches(data, offsets)
    end = np.append(start[1:], len(data))
    hashes, one, kind = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
    flat_a, first_a, count_a, flat_b, first_b, count_b, same = both.look_up(hashes, data, start[one], end[one])
    row = np.searchsorted(offsets, start, side="right") - 1
    a, a_of = flat_a[spread(first_a[kind], count_a[kind])], np.repeat(row, count_a[kind])
    b, b_of = flat_b[spread(first_b[kind], count_b[kind])], np.repeat(row, count_b[kind])
    for r in np.unique(row[~same[kind]]):
        part, keep_a, keep_b = data[offsets[r]:offsets[r + 1]], a_of != r, b_of != r
        if not (both.of_a.gives(a[~keep_a], part) and both.of_b.gives(b[~keep_b], part)):
            a, a_of, b, b_of = a[keep_a], a_of[keep_a], b[keep_b], b_of[keep_b]
    return a, a_of, b, b_of


def _lists(values: np.ndarray, of: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def aligned(docs: DataFrame, files: Files, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the tokens of A and B (``n_a``, ``n_b``),
    the groups between common ends (``n_groups``, ``groups_sha256`` of
    ``a1,a2|b1;...``), the overlapping pairs of token occurrences (``n_links``),
    how many of these have an id pair that no other pair of the same A id exceeds
    in documents (``n_best``), and the documents of their pairs, summed
    (``count_sum``).

    A encodes a space and the text, B the text, to which it adds the space itself.
    Special tokens' strings are plain text. A null or empty text, and one whose bytes
    do not come back from either side's tokens, has no tokens: zeros and ''. A repeated
    row is a document of its own; an empty table gives an empty result; other columns
    pass through, those named like added ones are replaced.

    Texts are worked on in blocks of ``BLOCK`` bytes or one longer text, and a
    block names its id pairs by their place in the block's own dictionary. Only
    dictionaries are shuffled to be counted; a pair that all blocks hold is a skewed
    join side that Spark splits, and the counts come back to the block by its number.
    """
    aside, back = set_aside(docs, text, *NUMBERS, "groups_sha256")
    rows = docs.select(*aside, F.col(quoted(text)).alias("text"))
    spark = docs.sparkSession
    shared, width = spark.sparkContext.broadcast((files.a, files.b)), files.b_size()  # two vocabulary files, a few MB
    passed = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "text"]
    counted = [T.StructField(c, T.LongType()) for c in NUMBERS[:4]]
    listed = [T.StructField(c, T.ArrayType(k)) for c, k in (("of", T.IntegerType()), ("times", T.IntegerType()), ("pair", T.LongType()), ("held", T.IntegerType()))]
    schema = T.StructType([*passed, *counted, T.StructField("groups_sha256", T.StringType()), T.StructField("block", T.LongType()), *listed])
    names = [f.name for f in passed]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = Both(Files(*shared.value)), TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("text").cast(pa.large_string()).fill_null("")
            space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
            column = pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(space, column, none))
            data, offsets = utf8(column)
            for lo, hi in chunks(offsets, BLOCK):
                n = hi - lo
                part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                a, a_of, b, b_of = _tokens(both, part, at)
                groups, digests, of, x, y = align(both, a, b, a_of, b_of, n)
                pairs = len(both.of_a.entries) * width
                own, times = np.unique(of * pairs + x * width + y, return_counts=True)
                pair, place, held = np.unique(own % pairs, return_inverse=True, return_counts=True)
                block += 1
                texts = [*[batch.column(c).slice(lo, n) for c in names],
                         *[pa.array(z, pa.int64()) for z in (np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), groups, np.bincount(of, minlength=n))],
                         pa.array(digests, pa.string()), pa.array(np.full(n, block)),
                         _lists(place, own // pairs, n, pa.int32()), _lists(times, own // pairs, n, pa.int32()),
                         pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(texts, names=schema.names)
                whole = np.zeros(len(pair), np.int64)
                entry = [pa.nulls(1, z.type) for z in texts[:-5]]
                entry += [pa.array([block]), *[pa.nulls(1, pa.list_(pa.int32()))] * 2, _lists(pair, whole, 1, pa.int64()), _lists(held, whole, 1, pa.int32())]
                yield pa.RecordBatch.from_arrays(entry, names=schema.names)

    table = materialize(rows.mapInArrow(encode, schema), "tokens")
    texts = table.where("pair is null").select(*names, *NUMBERS[:4], "groups_sha256", "block", "of", "times")
    pairs = table.where("pair is not null").select("block", F.posexplode(F.arrays_zip("pair", "held")).alias("place", "p")).select(
        "block", "place", "p.pair", "p.held")
    counts = pairs.groupBy("pair").agg(F.sum("held").cast("long").alias("n"))
    # an A id has no more pairs than B has ids
    best = Window.partitionBy(F.expr(f"pair div {width}"))
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(best)).alias("best"))
    answers = pairs.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("dictionary"), "place", "n", "best")
    result = T.StructType([*passed, *counted, *[T.StructField(c, T.LongType()) for c in NUMBERS[4:]], T.StructField("groups_sha256", T.StringType())])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        n, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = right.column("place").to_numpy()
        n[place], top[place] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        of, times = left.column("of").combine_chunks(), left.column("times").combine_chunks()
        row = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy())
        of, times = of.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = []
        for each in (top, n):
            running = np.concatenate([[0], np.cumsum(times * each[of])])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=left.num_rows))])
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
        columns = [*[left.column(c) for c in [*names, *NUMBERS[:4]]], *sums, left.column("groups_sha256")]
        return pa.table(columns, names=result.names)

    out = texts.groupBy("block").cogroup(answers.groupBy("dictionary")).applyInArrow(total, result)
    return out.select(*back, *NUMBERS, "groups_sha256")
