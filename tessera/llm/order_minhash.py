"""Near duplicates by order MinHash.

A sketch element takes the ``take`` occurrence-labelled five-word shingles
with the least hashes and keeps them in text order, so it agrees for texts
that share content in the same order (Marcais et al., "Locality-sensitive
hashing for the edit distance"). Texts that share an element are candidates;
a banded alignment of their shingles verifies them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.frames import quoted, set_aside
from tessera.llm.text import U, _BASE, each_chunk, grams, mix, seeds, utf8, words
from tessera.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
# (shingles per element, elements, shared): texts of similarity 0.8 share so many
# elements or more with a probability of over 0.9995 in each row, counted without
# replacement: texts of up to TINY shingles have MORE elements, the last row is for
# texts of over SIMILARITY * SHORT
LEVELS = ((3, 12, 1), (12, 150, 2))
TINY, MORE = 16, 4
SHORT = 400  # shingles of the texts that are compared by their rarest shingles last, which misses no pair
BITS = 512   # of a text's parity map
LONG = 4096  # of the maps on the last level, where texts of over SIMILARITY * SHORT shingles are compared in all pairs
SAMPLED = 16  # one in so many open texts tells which shingles are common
RARE = 256    # a shingle that fewer than one in so many of these hold isn't
CROWD = 64    # texts that are joined on one shingle without exact counts
SMALL = 16  # texts of an element that are compared in pairs at once
LEADERS = 16
FIRST = 4   # elements of the first level that are compared before the others


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingles of one text, told apart by their occurrence number."""
    own = grams(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.zeros(0, U)
    order = np.argsort(own, kind="stable")
    sorted_ = own[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(own) else np.zeros(0, np.int64)
    if len(first) == len(own):
        return own
    number = np.empty(len(own), U)
    number[order] = (np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))).astype(U)
    return mix(own + number * U(0xD6E8FEB86659FD93))


def sketch(shingles: np.ndarray, take: int, elements: int) -> np.ndarray:
    """``elements`` keys of a text."""
    n, out = len(shingles), np.zeros(elements, U)
    salts = seeds(elements, take)
    step = max(1, (1 << 20) // max(n, 1))
    for lo in range(0, elements, step):
        salt = salts[lo:lo + step, None]
        values = mix(shingles[None, :] ^ salt)
        if n > take:
            at = np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(salt), n))
        chosen, key = shingles[at], salt[:, 0].copy()
        for j in range(chosen.shape[1]):
            key = mix(key * U(_BASE) + chosen[:, j])
        out[lo:lo + step] = key
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all, where shared are those of the best alignment:
    the longest run of common labelled shingles in the same order in both. A
    similarity of SIMILARITY leaves room for (n + m) / 9 shingles without a
    partner, so only matches within that band of the diagonal can count. Less
    than SIMILARITY may be returned as 0."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < SIMILARITY * max(n, m):
        return 0.0
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (n + m) * (1 - 2 * SIMILARITY / (1 + SIMILARITY)) + 1e-9
    inside = np.abs(at - bt) <= band
    at, bt = at[inside], bt[inside]
    if len(at) < SIMILARITY * (n + m - len(at)):
        return 0.0
    bt = bt[np.argsort(at)]
    if np.all(np.diff(bt) > 0):
        best = len(bt)
    else:
        tails: list[int] = []
        for x in bt.tolist():
            i = bisect.bisect_left(tails, x)
            tails[i:i + 1] = [x]
        best = len(tails)
    return best / (n + m - best)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _worded(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))


def sketches(texts: DataFrame, take: int, elements: int, least: int = 0) -> DataFrame:
    """(node, doc, n, element, key) of ``texts`` (node, doc, text): ``elements`` rows, or MORE for
    TINY texts, for each text with ``n`` shingles; wordless texts and those of up to ``least`` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_chunk(batch):
                nodes, ids = (batch.column(c).slice(lo, hi - lo) for c in ("node", "doc"))
                rows = np.flatnonzero(np.diff(w.first))
                if not len(rows):
                    continue
                own = [labelled(w.hash[w.first[r]:w.first[r + 1]]) for r in rows]
                rows, own = rows[[len(x) > least for x in own]], [x for x in own if len(x) > least]
                if not own:
                    continue
                count = np.array([elements + MORE * (len(x) <= TINY) for x in own])
                keys = np.concatenate([sketch(x, take, k) for x, k in zip(own, count)])
                each = pa.array(np.repeat(rows, count))
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(each), ids.take(each), pa.array(np.repeat([len(x) for x in own], count), pa.int64()),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in count])), pa.array(keys.view(np.int64))],
                    names=["node", "doc", "n", "element", "key"])

    return texts.mapInArrow(run, "node binary, doc long, n long, element int, key long")


def _parities(own: list[np.ndarray], size: int) -> pa.Array:
    """For each text's shingles and each of ``size`` buckets, whether an odd number of them falls into it."""
    odd = np.array([(np.bincount((x % U(size)).astype(np.int64), minlength=size) & 1).astype(bool) for x in own])
    bits = np.packbits(odd, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * (size // 64)).astype(np.int32)), pa.array(bits.ravel()))


def maps(texts: DataFrame, size: int) -> DataFrame:
    """(node, bits) of ``texts`` (node, text): their parity maps, whatever their length; wordless texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_chunk(batch):
                rows = np.flatnonzero(np.diff(w.first))
                if len(rows):
                    own = [labelled(w.hash[w.first[r]:w.first[r + 1]]) for r in rows]
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo).take(pa.array(rows)), _parities(own, size)], names=["node", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node binary, bits array<long>")


def profiles(texts: DataFrame) -> DataFrame:
    """(node, n, own, bits) of ``texts`` (node, text) of up to SHORT shingles: the shingles and the parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_chunk(batch):
                own = [(r, labelled(w.hash[w.first[r]:w.first[r + 1]])) for r in np.flatnonzero(np.diff(w.first))]
                own = [(r, x) for r, x in own if len(x) <= SHORT]
                if not own:
                    continue
                size = np.array([len(x) for _, x in own])
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo).take(pa.array([r for r, _ in own])), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x for _, x in own]).view(np.int64))),
                     _parities([x for _, x in own], BITS)],
                    names=["node", "n", "own", "bits"])

    return texts.mapInArrow(run, "node binary, n long, own array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose aligned similarity is SIMILARITY or more. ``texts``: (node, text), one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, np.ndarray] = {}

        def shingles(node: bytes, text: str) -> np.ndarray:
            if node not in kept:
                while len(kept) >= 200:
                    kept.pop(next(iter(kept)))
                data, offsets = utf8(pa.array([text], pa.string()))
                kept[node] = labelled(words(data, offsets).hash)
            return kept[node]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = [similarity(shingles(a, x), shingles(b, y)) for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")))]
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(np.array(score) >= SIMILARITY)))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _close(a: str | Column, b: str | Column) -> Column:
    """Whether texts of so many shingles can have SIMILARITY at all."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _alike(n_a: Column, n_b: Column, bits_a: list[Column], bits_b: list[Column]) -> Column:
    """Whether parity maps allow SIMILARITY: such texts differ in (n + m) / 9 shingles at
    most, and so in no more bits."""
    apart = reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b)])
    return apart <= (n_a + n_b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def _map(bits: Column, size: int = BITS) -> list[Column]:
    return [bits[i] for i in range(size // 64)]


def _own(buckets: DataFrame) -> list[str]:
    """What candidates are judged by; ``buckets`` may lack the parity maps."""
    return [c for c in ("node", "n", "label", "bits") if c in buckets.columns]


def _leaders(buckets: DataFrame, leaders: int) -> DataFrame:
    """(key, leaders): one row per element with the earliest text of each of ``leaders`` hashed parts."""
    part = F.pmod(F.xxhash64("node"), F.lit(leaders))
    least = buckets.groupBy("key", part.alias("part")).agg(F.min_by(F.struct(*_own(buckets)), F.struct("doc", "node")).alias("least"))
    return least.groupBy("key").agg(F.collect_list("least").alias("leaders"))


def _stars(buckets: DataFrame, leaders: int) -> DataFrame:
    """Candidates (a, b): each text of an element with its earliest text, or
    with the earliest of each of ``leaders`` hashed parts. A leader that a text meets
    in several elements is one candidate before any pair becomes a row, and pairs that
    lengths or parity maps exclude never become one."""
    def possible(x: Column) -> Column:
        found = (F.col("node") != x["node"]) & (F.col("label") != x["label"]) & _close(F.col("n"), x["n"])
        return found & _alike(F.col("n"), x["n"], _map(F.col("bits")), _map(x["bits"])) if "bits" in buckets.columns else found

    others = F.filter("leaders", possible)
    both = buckets.join(_leaders(buckets, leaders), "key").select("node", F.transform(others, lambda x: x["node"]).alias("others"))
    met = both.where(F.size("others") > 0).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    pairs = met.select("node", F.explode("others").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _pairs(buckets: DataFrame, shared: int, size: int = BITS) -> DataFrame:
    """Candidates (a, b): all pairs of texts that share ``shared`` elements, but for
    those that lengths or parity maps exclude."""
    left, right = (buckets.select("key", *(F.col(c).alias(f"{c}_{side}") for c in _own(buckets))) for side in "ab")
    both = left.join(right, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _close("n_a", "n_b"))
    if "bits" in buckets.columns:
        both = both.where(_alike(F.col("n_a"), F.col("n_b"), _map(F.col("bits_a"), size), _map(F.col("bits_b"), size)))
    return both.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("a", "b")


def _common(every: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample hold, in order: a share of 1 / RARE of it or more, so
    there are RARE * SHORT of them at most, whatever the input. They only choose an order."""
    sample = every.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("own")
    least = max(3, -(-sample.count() // RARE))
    held = sample.select(F.explode("own").alias("key")).groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    return np.sort(held.select("key").toPandas()["key"].to_numpy(np.int64))


def _prefixes(every: DataFrame, common: np.ndarray) -> DataFrame:
    """(node, label, key) of the shingles of which a pair of SIMILARITY has one in common, if all
    are ordered by their hash, with the ``common`` ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            size, own = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((own, np.isin(own, common), row))
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            use = at < (size - np.ceil(SIMILARITY * size - 1e-6) + 1)[row]
            each = pa.array(row[use])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(each), batch.column("label").take(each), pa.array(own[order][use])],
                                             names=["node", "label", "key"])

    return every.select("node", "label", "own").mapInArrow(run, "node binary, label binary, key long")


def _by_rarity(every: DataFrame) -> DataFrame:
    """(node, key) as of _prefixes, but ordered by how many of the texts hold a shingle."""
    tokens = every.select("node", "label", "n", F.explode("own").alias("key"))
    held = tokens.groupBy("key").agg(F.count("*").alias("texts"), (F.min("label") != F.max("label")).alias("several")).where("texts > 1")
    listed = tokens.join(held, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "key", "several"))).alias("keys"))
    # what one text alone holds comes first
    first = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-6) + 1 - (F.col("n") - F.size("keys"))
    listed = listed.withColumn("first", first.cast("int")).where("first > 0")
    keys = listed.select("node", F.explode(F.slice("keys", F.lit(1), F.col("first"))).alias("k"))
    return keys.where("k.several").select("node", "k.key")


def _near_on(keys: DataFrame, every: DataFrame) -> DataFrame:
    """Candidates (a, b) with a key of (node, key) in common, of different labels, that
    lengths and parity maps allow."""
    keys = materialize(keys.join(every.drop("own"), "node"), "rare")
    left, right = (keys.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "label")),
                               *(F.col("bits")[i].alias(f"{side}{i}") for i in range(BITS // 64))) for side in "ab")
    bits_a, bits_b = ([F.col(f"{side}{i}") for i in range(BITS // 64)] for side in "ab")
    both = left.join(right, (left["key"] == right["key"]) & (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
                     & _close("n_a", "n_b") & _alike(F.col("n_a"), F.col("n_b"), bits_a, bits_b))
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _rare_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates (a, b): all pairs of ``texts`` of up to SHORT shingles that can
    have SIMILARITY, but for those of one label.

    Such a pair has SIMILARITY of each one's shingles in common, so it has one in
    common among the (1 - SIMILARITY) * n + 1 of each that come first in any one order
    of all shingles. The first order needs no counts: by hash, with what many texts
    of a sample hold last. Pairs are joined on such shingles if up to CROWD texts have them
    there. A pair without one has a crowded one in common, so both its texts are
    among those with a crowded one; these are joined again, ordered by exact counts."""
    every = materialize(_labelled(profiles(texts), labels), "profiles")
    keys = materialize(_prefixes(every, _common(every)), "prefixes")
    held = keys.groupBy("key").agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    keys = materialize(keys.join(held.select("key", "texts"), "key").select("node", "key", "texts"), "prefixes")
    pairs = _near_on(keys.where(F.col("texts") <= CROWD).select("node", "key"), every)
    crowded = every.join(keys.where(F.col("texts") > CROWD).select("node").distinct(), "node", "left_semi")
    crowded = materialize(crowded, "crowded")
    return pairs.union(_near_on(_by_rarity(crowded), crowded))


def _sized(buckets: DataFrame) -> DataFrame:
    return buckets.join(buckets.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "key")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, label): the components of the verified links between different
    texts, by their digests; texts without links are absent.

    Texts that share an element are compared with its earliest text first, which
    binds copies to their original in as many comparisons as there are copies.
    What is in one component then needs no more comparisons. Other texts are
    compared in all pairs if their element has up to SMALL, or else with the earliest
    of each of LEADERS parts. Large elements whose texts are still in several
    components are texts about one common passage, or groups that their leaders
    don't bind. Of these, texts of up to SHORT shingles are joined on their rarest
    shingles, which finds all their pairs; longer ones are sketched again with more
    shingles per element, which only texts alike all over still share. What the last
    level leaves is compared pair by pair, so no candidate is dropped. Pairs whose
    lengths or parity maps exclude the similarity aren't compared.
    """
    doc = F.coalesce(F.col(quoted(key)).cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    texts = docs.select(_digest(F.col(quoted(text))).alias("node"), doc, F.col(quoted(text)).alias("text")).where("text is not null")
    found, labels, own = [], None, texts
    for level, (take, elements, shared) in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        buckets = sketches(own, take, elements, int(SIMILARITY * SHORT) if last else 0)
        if level == 0:  # copies; later levels have a text once
            buckets = buckets.groupBy("node", "n", "element", "key").agg(F.min("doc").alias("doc"))
        buckets = buckets.withColumn("label", F.col("node"))
        if labels is not None:
            buckets = _labelled(buckets, labels)
        buckets = materialize(_sized(buckets), "buckets")
        if level == 0:
            known = buckets.select("node", "doc").distinct()
            own = texts = materialize(texts.join(known, ["node", "doc"], "left_semi").dropDuplicates(["node"]), "texts")
            bits = materialize(maps(texts, BITS), "maps")
            # a few elements first: most of a group's texts are then known to be in it
            found.append(materialize(verified(_stars(buckets.where(F.col("element") < FIRST).join(bits, "node"), 1), texts), "verified"))
            buckets = _labelled(buckets, components(found[0]))
        else:
            bits = materialize(maps(own, LONG), "maps")
        large, mapped = F.col("texts") > SMALL, buckets.join(bits, "node")
        if last:
            pairs = _pairs(mapped, shared, LONG).union(_rare_pairs(own, labels)).distinct()
        else:
            pairs = _stars(mapped.where(large), LEADERS).union(_pairs(mapped.where(~large), shared)).distinct()
        found.append(materialize(verified(pairs, texts), "verified"))
        labels = components(reduce(DataFrame.union, found))
        if last:
            break
        known = _labelled(buckets.where(large), labels)
        several = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        left = materialize(known.join(several, "key").select("node").distinct(), "open")
        if left.isEmpty():
            break
        own = texts.join(left, "node", "left_semi")
    return labels


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest, label, least, size), one row per document."""
    labels = links(docs, key, text).withColumnRenamed("node", "digest")
    column = F.col(quoted(text))
    rows = docs.select(F.col(quoted(key)).alias("doc_id"), F.when(_worded(column), _digest(column)).alias("digest"))
    rows = rows.join(labels, "digest", "left").select("doc_id", "digest", F.coalesce("label", "digest").alias("label"))
    rows = materialize(rows, "members")
    sizes = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    return rows.join(sizes, "label", "left")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, ``class_id`` (the least key of its class)
    and ``class_size`` (documents).

    A class is a connected component under equality of texts and links. Texts
    are linked if their aligned similarity over five-word shingles is SIMILARITY
    or more; a text of fewer words is one shingle, so it is linked to texts of the
    same words. Copies are one text: they are not compared or expanded into pairs.

    Null and wordless texts are classes of their own, one per row; repeated rows
    are copies; a null key joins a class but doesn't name it unless all its keys
    are null; an empty table gives an empty result; other columns are ignored.
    """
    return _members(docs, key, text).select(
        F.col("doc_id").alias(key), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: of its least key and, should several
    texts stand there, of the least digest. Wordless rows all stay."""
    aside, back = set_aside(docs)
    first = _members(docs, key, text).where(F.col("label").isNotNull() & F.col("doc_id").eqNullSafe(F.col("least")))
    first = first.groupBy("label").agg(F.min("digest").alias("best"), F.first("least").alias("least")).select("best", "least")
    column = F.col(quoted(text))
    rows = docs.select(*aside, F.col(quoted(key)).alias("key"), _worded(column).alias("worded"), _digest(column).alias("digest"))
    kept = rows.where("worded").join(first, (F.col("digest") == F.col("best")) & F.col("key").eqNullSafe(F.col("least")), "left_semi")
    return kept.dropDuplicates(["digest"]).union(rows.where("not worded")).select(*back)
