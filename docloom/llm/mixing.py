"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into BLOCKS blocks by a hash, and a source that needs more words than it has
is read again in a further epoch.  Of its last, partial epoch it takes whole blocks in a permuted order, then
whole documents of the boundary block, then the first words of one document, so each target is met to the word.
The tree halves the exact block counts of all sources among the output shards, node by node; each shard then
draws its own run of every source's permuted blocks, and shuffles locally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, lookup, packed, small, unpacked

#: Blocks of each source: a hot source's rows are spread over so many keys.
BLOCKS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
#: Places (source, block, epoch) that are broadcast at most, some 40 MB: beyond, each text travels twice.
WIDE = 400_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over the sources by code point, null last.  A target is min(most * size, level * weight); the
    level is where the targets sum to ratio * all sizes, found in one pass over the sources in the order in
    which they reach their limit.  The table has one row for each source, so its windows are small.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    rows = sizes.withColumn("_turn", turn - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_all", ratio * F.sum("source_size").over(every)).withColumn("_wall", F.sum("_w").over(every))
    full, used = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (F.col("_all") - full) / (F.col("_wall") - used)
    rows = rows.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    level = F.max("_level").over(every)
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("_cap")).otherwise(F.least("_cap", level * F.col("_w"))).cast("double").alias("target"))


def shuffled(*key: Column | str, seed: int) -> Column:
    """A permutation key that any SQL engine can give: md5 of the key's parts and the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k, F.lit("")) for k in key]))


def splitting_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: columns sum to `counts`, rows differ by one block at most.

    Each node splits its counts between its halves by a multivariate hypergeometric draw, done as a chain of
    univariate ones, so that no count is too large for it.  Without sources there are no columns; a source of no
    blocks has zeros; equal seeds give equal tables.
    """
    rng = np.random.default_rng(seed)

    def node(own: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [own]
        total, half = int(own.sum()), n // 2
        want, rest, left = total * half // n, total, np.zeros_like(own)
        for k, x in enumerate(own.tolist()):
            rest -= x
            left[k] = min(x, want) if not rest else (_hypergeometric(rng, x, rest, want) if want else 0)
            want -= int(left[k])
        return node(left, half) + node(own - left, n - half)

    return np.array(node(np.asarray(counts, np.int64), shards)).reshape(shards, -1)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    mean, total = draws * good / (good + bad), good + bad
    spread = (mean * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    return int(np.clip(round(rng.normal(mean, spread)), max(0, draws - bad), min(good, draws)))


def dealt(docs: DataFrame, source: str, seed: int, **own: Column) -> DataFrame:
    """All columns of `docs` but the text in `row`, with `text`, `source`, `block`, `doc_id` and `own`."""
    block = F.conv(F.substring(shuffled("doc_id", seed=seed), 1, 3), 16, 10).cast("int")
    return packed(docs, ("text",), text=F.col("text"), doc_id=F.col("doc_id"), source=F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")), block=block, **own)


def block_plan(rows: DataFrame, weights: tuple[float, ...], ratio: float, seed: int) -> DataFrame:
    """(source, block, bsize, source_size, target, epochs, left) of each block: `left` words go to it and those after it."""
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("bsize"))
    sizes = targets(blocks.groupBy("source").agg(F.sum("bsize").alias("source_size")), weights, ratio)
    blocks = blocks.join(sizes, "source")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks = blocks.withColumn("epochs", full).withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy(shuffled("block", seed=seed + 1), "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("bsize").over(order), F.lit(0))).drop("rest")


def with_taken(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` (source, block, doc_id, size, epochs, left) with `taken`: full epochs, and of the partial one what is left when a document's turn in its block comes.

    Turns are in order of a hash.  A block is dealt into parts by the hash's first digits, whose words are summed first,
    so that no window has more than one part of a block: 1 / 4096 of it.
    """
    turn = shuffled("doc_id", seed=seed + 2)
    rows = rows.withColumn("turn", turn).withColumn("part", F.substring("turn", 1, 3))
    sums = rows.groupBy("source", "block", "part").agg(F.sum("size").alias("psize"))
    earlier = Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", "part", F.coalesce(F.sum("psize").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("source", "block", "part").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("parts_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.join(sums, ["source", "block", "part"]).withColumn("before", before)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("before", "parts_before", "turn", "part")


def plan_mix(docs: DataFrame, size: Column, source: str = "source", weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, seed: int = 11) -> DataFrame:
    """The rows of `docs` with `_size`, `_source_size`, `_target` and `_taken`.

    `_taken` is how many words the mix takes of the document, repeats counted: full epochs of its size, and what
    the partial epoch takes of it.  Null sources are a source of their own; documents without words take none;
    rows alike in doc_id and size are told apart by nothing and may stand in either order.  An empty table gives no
    rows.  Columns of `docs` may have any name; those named like a result are replaced.
    """
    rows = dealt(docs, source, seed, size=size)
    rows = with_taken(rows.join(block_plan(rows, weights, ratio, seed), ["source", "block"]), seed)
    return unpacked(rows, docs, text=F.col("text"), _size=F.col("size"), _source_size=F.col("source_size"), _target=F.col("target"), _taken=F.col("taken"))


def shard_quotas(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, first, stop): each shard's run of every source's drawn blocks, from the splitting tree.

    `drawn` has each (source, epoch, block) of which the plan takes words.  The driver sees one count for each
    source; the table has one row for each source and shard.
    """
    spark = drawn.sparkSession
    counts = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    sources = sorted(counts)
    table = np.cumsum(splitting_tree(np.array([counts[s] for s in sources], np.int64), shards, seed), axis=0)
    rows = [(s, k, int(table[k - 1, j]) if k else 0, int(table[k, j])) for j, s in enumerate(sources) for k in range(shards)]
    return spark.createDataFrame(rows, "source string, shard int, first long, stop long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, shards: int = 16, seed: int = 11, size: Column | None = None) -> DataFrame:
    """The mixed corpus: the rows of `docs`, as often as drawn, with `_shard`, `_epoch` and `_take` (words).

    A document of which the mix takes only the first words has its text cut after them, white space and lines as they
    were.  Within a shard rows are in a permuted order of blocks, permuted again inside each block.  Texts are dealt out
    once, to their shards: all of a block is taken or none, but for the one block of each source in which its words run
    out.  Null texts have no words and are never drawn; null sources are a source of their own; rows that repeat are
    drawn each; an empty table gives no rows.  Columns of `docs` may have any name; those named like a result are replaced.  `size` is a text's number of words, where `docs` has it already.
    """
    rows = dealt(docs, "source", seed, size=n_words(F.col("text")) if size is None else size)
    blocks = checkpointed(block_plan(rows, weights, ratio, seed)).where("bsize > 0")
    epochs = F.col("epochs") + F.when(F.col("left") > 0, 1).otherwise(0)
    drawn = checkpointed(blocks.where(epochs > 0).select("source", F.explode(F.sequence(F.lit(0).cast("long"), epochs.cast("long") - 1)).alias("epoch"), "block", F.expr("if(left > 0 and left < bsize, left, null)").alias("left"), "epochs"))
    quotas = shard_quotas(drawn, shards, seed).withColumnRenamed("source", "of")
    rank = Window.partitionBy("source").orderBy(shuffled("epoch", "block", seed=seed + 3), "epoch", "block")
    places = drawn.withColumn("rank", F.row_number().over(rank) - 1)
    places = places.join(quotas, (F.col("source") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    places = checkpointed(places.select("source", "block", "epoch", "shard", "rank", (F.col("epoch") == F.col("epochs")).alias("last"), "left"))
    out = ["row", "doc_id", "text", "shard", "epoch", "take", "rank", "block"]
    whole = rows.where("size > 0").join(small(places.where("left is null or not last"), WIDE), ["source", "block"])
    whole = whole.withColumn("take", F.col("size")).select(*out)
    part = rows.join(small(places.where("left is not null and last").withColumn("epochs", F.lit(0))), ["source", "block"])
    part = with_taken(part, seed).where("taken > 0").withColumn("take", F.col("taken"))
    part = part.withColumn("text", F.when(F.col("take") < F.col("size"), first_words(F.col("text"), F.col("take"))).otherwise(F.col("text"))).select(*out)
    local = [F.col("shard"), shuffled("rank", "shard", seed=seed + 4), shuffled("doc_id", "epoch", seed=seed + 5)]
    mixed = whole.union(part).repartition("shard", "block").sortWithinPartitions(*local)
    return unpacked(mixed, docs, text=F.col("text"), _shard=F.col("shard"), _epoch=F.col("epoch"), _take=F.col("take"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of each row of `docs`, by drawing the mix.

    `taken` counts the words of the texts that `mix` deals to its shards.  Rows alike in doc_id, source and size are
    told apart by nothing: what they take together is dealt to one after the other, epoch by epoch.
    """
    docs = docs.select("doc_id", F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("of"), "source", "text", n_words(F.col("text")).alias("size"))
    # A list, as its order counts for the optimizer: with a sum it would leave out the shuffle inside the shards.
    drawn = mix(docs, size=F.col("size"), **options).groupBy(F.col("doc_id").alias("id"), "of", "size").agg(F.collect_list(n_words(F.col("text"))).alias("drawn"))
    drawn = drawn.select("id", "of", "size", F.aggregate("drawn", F.lit(0).cast("long"), lambda n, x: n + x).alias("words"))
    rows = checkpointed(docs.groupBy("doc_id", "of", "size").agg(F.count(F.lit(1)).alias("copies")))
    own = {k: options[k] for k in ("weights", "ratio") if k in options}
    sizes = targets(rows.groupBy(F.col("of").alias("source")).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), **own).withColumnRenamed("source", "of")
    rows = lookup(rows, checkpointed(sizes), ["of"], F.col("doc_id")).withColumnRenamed("of", "s").withColumnRenamed("size", "z")
    rows = rows.join(drawn, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("s") == F.col("of")) & (F.col("z") == F.col("size")), "left").drop("size", "of")
    rows = rows.withColumnRenamed("z", "size").withColumn("words", F.coalesce("words", F.lit(0).cast("long"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    once = "greatest(copies * size, 1)"  # words of one epoch
    taken = F.expr(f"(words div {once}) * size + greatest(0, least(size, words % {once} - k * size))")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text as far as the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each but the last ends with a word
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(1)).cast("int")), "")
