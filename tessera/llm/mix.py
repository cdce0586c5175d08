"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Each source's words are cut into blocks; its target gives an exact quota of
blocks. A binary tree over the output shards splits the quotas: at each node
the left half's blocks are a multivariate-hypergeometric draw from the node's,
as if all blocks were shuffled and dealt out. A source's blocks stand in a
permuted order, and each shard takes the next range of it, so the draws are
disjoint. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import quoted, set_aside
from tessera.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
EPOCHS = 3         # a source is taken at most so many times
SHARDS = 16
BLOCK_WORDS = 256  # words of a block; less in sources of under BLOCKS of them
BLOCKS = 512
PARTS = 256        # pieces in which a source's running word counts are made


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """Number of good among ``draws`` from good + bad, by inversion at ``u`` in
    [0, 1). The probabilities, each from the one before by their ratio, run over
    the whole support, or 9 deviations about the mean and 12 terms more, beyond
    which double precision holds nothing."""
    total = F.greatest(good + bad, F.lit(1))
    mean = draws * good / total
    spread = 9 * F.sqrt(mean * bad / total) + 12
    low = F.greatest(F.lit(0), draws - bad, F.floor(mean - spread)).cast("long")
    high = F.least(good, draws, F.ceil(mean + spread)).cast("long")

    def inverted(b):
        def step(s, k):
            ratio = (good - k) * (draws - k).cast("double") / ((k + 1) * (bad - draws + k + 1).cast("double"))
            return F.struct((s["sum"] + s["p"]).alias("sum"), (s["p"] * ratio).alias("p"),
                            (s["n"] + F.when(s["sum"] + s["p"] <= s["bound"], 1).otherwise(0)).cast("long").alias("n"), s["bound"].alias("bound"))

        def start(bound):
            return F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("p"), F.lit(0).cast("long").alias("n"), bound.alias("bound"))

        span = F.sequence(b["low"], b["high"])
        everything = F.aggregate(span, start(F.lit(0.0)), step)["sum"]
        return let(everything, lambda e: F.least(b["low"] + F.aggregate(span, start(u * e), step)["n"], b["high"]))

    return let(F.struct(low.alias("low"), high.alias("high")), inverted)


def uniform(*parts) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(*parts), 11), F.lit(1 << 52)) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target``.

    ``sizes`` has source and size. Sources in code point order, null last, take
    the weights in turn and share all words by weight; a target stops at EPOCHS
    times its source's size and the excess is shared anew by weight. This is one
    level L: target = min(EPOCHS * size, L * weight); the sources below it are
    those with the least EPOCHS * size / weight, so running sums in that order
    give L. The sources of a mixture are listed with their weights, so this
    table is as small as that list.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    own = own.withColumn("weight", F.get(turn, rank % len(WEIGHTS)))
    own = own.withColumn("cap", (EPOCHS * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level", (F.sum("source_size").over(everything) - capped) / rest)
    # the first source that the level does not fill fixes it; from there on the values fall
    own = own.withColumn("fills", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    own = own.withColumn("level", F.max("fills").over(everything))
    return own.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(sources: DataFrame) -> DataFrame:
    """Adds ``block`` (its words), ``n_blocks`` and ``quota`` (blocks taken)."""
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / BLOCKS)))
    out = sources.withColumn("block", block.cast("long"))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.withColumn("quota", F.least(F.round(share * F.col("n_blocks")), EPOCHS * F.col("n_blocks")).cast("long"))


def split(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row per source: ``cuts``, the ``shards`` + 1 bounds of the ranges of
    its drawn blocks that the output shards take. All shards get equally many
    blocks, to one."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota")))
    nodes = sources.agg(listed.alias("own")).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["quota"]).alias("blocks"),
        F.transform("own", lambda s: s["quota"]).alias("counts"), F.transform("own", lambda s: s["source"]).alias("names"))
    nodes = nodes.withColumn("all", F.col("blocks")).select("low", "high", "counts", "names", "all")

    def bound(i: Column) -> Column:  # first block of shard i, when all blocks stand in a row
        return F.floor(F.col("all") * i / shards).cast("long")

    for _ in range(max(1, (shards - 1).bit_length())):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        draws = bound(middle) - bound(F.col("low"))
        start = F.struct(F.array().cast("array<bigint>").alias("left"), draws.alias("draws"), (bound(F.col("high")) - bound(F.col("low"))).alias("rest"))

        def draw(state, count):
            i = F.size(state["left"])
            x = hypergeometric(count, state["rest"] - count, state["draws"], uniform(F.lit(seed), F.lit("node"), F.col("low"), F.col("high"), i))
            return let(x, lambda x: F.struct(F.concat(state["left"], F.array(x)).alias("left"), (state["draws"] - x).alias("draws"),
                                             (state["rest"] - count).alias("rest")))

        left = F.aggregate("counts", start, draw)["left"]
        halves = let(left, lambda x: F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high"), x.alias("counts")),
            F.struct(middle.alias("low"), F.col("high").alias("high"), F.zip_with("counts", x, lambda a, b: a - b).alias("counts"))))
        whole = F.array(F.struct("low", F.col("high").alias("high"), F.col("counts").alias("counts")))
        nodes = nodes.select("names", "all", F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole)).alias("n"))
        nodes = nodes.select("n.low", "n.high", "n.counts", "names", "all")
    leaves = nodes.select("low", F.explode(F.arrays_zip("names", "counts")).alias("x")).select("low", "x.names", "x.counts")
    dealt = leaves.groupBy("names").agg(F.transform(F.array_sort(F.collect_list(F.struct("low", "counts"))), lambda s: s["counts"]).alias("counts"))
    cuts = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return dealt.select(F.col("names").alias("source"), cuts.alias("cuts"))


def permuted(block: Column, n: Column) -> Column:
    """A permutation of 0 .. n - 1: multiplication by a number near n times the
    golden section, the first from there on that has no factor in common with n."""
    near = F.floor(n * 0.6180339887498949).cast("long")

    def gcd(a, b):  # Euclid's steps: 64-bit numbers take at most 92
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(
            s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1).cast("long"))).alias("b"))))["a"]

    tries = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda j: F.greatest(near + j, F.lit(1).cast("long"))),
                     lambda f: gcd(f, n) == 1)
    return F.coalesce(tries[0], F.lit(1).cast("long"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", shards: int = SHARDS, seed: int = 17,
        parts: int = PARTS) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``taken``
    and ``draws``: an array of (epoch, shard, position, from_word, words) in
    the order of the text, one for each time that a block of the document is
    drawn; ``position`` orders the shard, which is its local shuffle.

    Documents stand in hashed order within their source, and their words make
    up its blocks; a block may span documents, and a document is taken by the
    words, so that small sources meet their targets too. Each source's taken
    words differ from its target by at most one block. No block is drawn more
    than EPOCHS times, so no document is taken more than EPOCHS times its size.

    A null or wordless text has size 0 and is taken 0 times; a null source is a
    source; repeated rows count and are drawn separately; a table without words
    has all targets 0; an empty table gives an empty result; columns named like
    the added ones are replaced, others pass through. Reruns agree.

    Running word counts are made in ``parts`` pieces per source, joined by a
    table of parts * sources sums, so a source with a third of all rows is
    spread over many tasks. Only (source, piece, size) are written for the two
    passes over the sums; texts are shuffled only if the result holds them.
    """
    aside, back = set_aside(docs, "size", "source_size", "target", "taken", "draws")
    key, source, text = (F.col(quoted(c)) for c in (key, source, text))
    order = F.xxhash64(F.lit(seed), key, F.xxhash64(text))
    rows = docs.select(*aside, source.alias("source"), order.alias("order"), F.pmod(F.shiftright(order, 24), F.lit(parts)).cast("int").alias("part"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sums = materialize(rows.groupBy("source", "part").agg(F.sum("size").alias("size")), "mix-sums")
    sources = materialize(quotas(targets(sums)), "mix-sources")
    cuts = split(sources, shards, seed)
    same = F.col("s.source").eqNullSafe(F.col("c.source"))
    n = F.greatest(F.col("n_blocks"), F.lit(1).cast("long"))
    sources = sources.alias("s").join(cuts.alias("c"), same, "left").select(
        "s.source", "source_size", "target", "block", "n_blocks", "quota", "cuts", permuted(F.lit(0), n).alias("factor"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sums.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).drop("size")
    pieces = pieces.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", *[f"s.{c}" for c in sources.columns if c != "source"])
    running = Window.partitionBy("source", "part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0).cast("long")))
    both = rows.alias("r").join(pieces.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    both = both.select("r.*", *[f"p.{c}" for c in pieces.columns if c not in ("source", "part")])
    both = both.withColumn("begin", F.col("start") + F.col("ahead")).withColumn("end", F.col("begin") + F.col("size"))

    block, blocks, quota = F.col("block"), F.col("n_blocks"), F.col("quota")

    def draws_of(b):
        turn = (b * F.col("factor")) % blocks
        begin, end = F.greatest(F.col("begin"), b * block), F.least(F.col("end"), (b + 1) * block)
        times = F.floor(quota / blocks) + F.when(turn < quota % blocks, 1).otherwise(0)
        every = F.sequence(F.lit(0).cast("long"), F.lit(EPOCHS - 1).cast("long"))
        return F.transform(F.filter(every, lambda e: e < times), lambda e: drawn(e, e * blocks + turn, begin, end - begin))

    def drawn(epoch, at, begin, size):
        shard = F.size(F.filter("cuts", lambda c: c <= at)) - 1
        return F.struct(epoch.cast("int").alias("epoch"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.col("source"), at).alias("position"),
                        (begin - F.col("begin")).alias("from_word"), size.alias("words"))

    span = F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long"))
    draws = F.when(F.col("size") > 0, F.flatten(F.transform(span, draws_of)))
    taken = F.coalesce(F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]), F.lit(0).cast("long"))
    return both.withColumn("draws", draws).select(*back, "size", "source_size", "target", taken.alias("taken"), "draws")


def drawn_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of mix(), one for each epoch in which words of a document are
    drawn: ``text`` as it is where all its words are, else the drawn words joined
    by one space."""
    aside, back = set_aside(mixed, text, "draws")
    rows = mixed.select(*aside, F.col(quoted(text)).alias("text"), F.col("size").alias("words"), F.col("draws"),
                        F.explode(F.array_distinct(F.transform("draws", lambda d: d["epoch"]))).alias("epoch"))
    own = rows.withColumn("own", F.filter("draws", lambda d: d["epoch"] == F.col("epoch"))).drop("draws")
    taken = F.aggregate("own", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    parts = let(words, lambda w: F.flatten(F.transform("own", lambda d: F.slice(w, (d["from_word"] + 1).cast("int"), d["words"].cast("int")))))
    return own.withColumn("text", F.when(taken == F.col("words"), F.col("text")).otherwise(F.array_join(parts, " "))).select(*back, "text")
