"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

A shingle that occurs w times is a set of Poisson processes over the dyadic weight levels (0, 1], (1, 2], (2, 4]
... up to w: each level's process has the level's length as its rate and is the same in every document; of the
level that w cuts, the points above w are thinned out.  A point belongs to a random register, and a register's
value is its first point.  Two documents agree in a register with probability sum(min) / sum(max) of their
counts.  Points are made in order of time and only while they can still be first in some register.

Documents are linked if a band of theirs agrees and the exact multisets have the similarity; classes are the connected
components of all such links.  Texts with equal multisets are one node beforehand.  In a bucket of at most SMALL_BUCKET
nodes all pairs are compared.  In a larger one each node is compared with the bucket's leader.  Where nodes outside the
leader's class are left, those are compared with all nodes of the buckets that have this leader, in blocks which give a
spanning forest of the links they find.  So every pair with a common band is compared or is in one class by other links:
the classes don't depend on SMALL_BUCKET, which only says what is cheaper.  A pair of similarity 0.8 has no common band
with a chance of 3 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batches, checkpointed, counted_join, packed, records, small, text_key, unpacked

WORDS = 5
BANDS, ROWS = 26, 5
SMALL_BUCKET = 8
_NODE = "struct<doc_id:bigint,key:bigint>"
#: Up to so many (two nodes of 16 bytes) are broadcast to the texts.
FEW_PAIRS = 50_000
#: Where there are more links than LINKS, nodes of more than HUB of them meet them in several tasks.
LINKS, HUB = 1_000_000, 10_000
#: Nodes on either side of a block.
BLOCK = 512
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each; those for very long texts aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    both = []
    for b in (_BASE, _INVERSE):
        x = np.full(max(n, 1 << 16), b, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x, out=x))
    if n <= 1 << 16:
        _powers[:] = both
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and their counts; a text of fewer words is one shingle, an empty one none."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, end = edges[::2], edges[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * _U(0xD6E8FEB86659FD93) + _U(i + 1)
    return np.unique(mix(out), return_counts=True)


def bag_min_hash(items: np.ndarray, counts: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The signature of a multiset: one 64-bit value for each register."""
    streams, rate, low, weight = items, np.ones(len(items)), np.zeros(len(items)), counts.astype(np.float64)
    if counts.max(initial=0) > 1:
        parts = [(items, np.ones(len(items)), np.zeros(len(items)), weight)]
        level, base = 1, 1
        while (more := counts > base).any():
            n = int(more.sum())
            parts.append((mix(items[more] + _U(level * 0xA0761D6478BD642F % 2**64)), np.full(n, float(base)), np.full(n, float(base)), weight[more]))
            level, base = level + 1, base * 2
        streams, rate, low, weight = (np.concatenate(x) for x in zip(*parts))
    first, value = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    # By this time all registers are filled, nine times in ten; a block of points reaches it for most streams.
    enough = registers / max(1.0, float(counts.sum())) * (np.log(registers) + 2.5)
    n = int(np.clip(np.ceil(enough + 2 * enough**0.5 + 1), 1, 4096))
    now, at = np.zeros(len(streams)), 0
    while len(streams):
        point = mix(streams[:, None] + mix(np.arange(at + 1, at + n + 1, dtype=np.uint64)))
        time = -np.log(((point >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40)
        if len(streams) and rate.max() > 1:
            time /= rate[:, None]
        time = now[:, None] + np.cumsum(time, axis=1)
        now, ok = time[:, -1].copy(), time < first.max()
        cut = weight < low + rate
        if cut.any():  # the level is only part covered: points above the weight don't count
            above = (mix(point[cut]) >> _U(11)).astype(np.float64) * 2.0**-53 * rate[cut][:, None] + low[cut][:, None] >= weight[cut][:, None]
            ok[cut] &= ~above
        for part in (ok & (time < enough), ok & (time >= enough)):
            p, t = point[part], time[part]
            order = np.argsort(-t)  # the earliest point of a register is assigned last
            p, t, register = p[order], t[order], ((p[order] & _U(0xFFFFFF)) * _U(registers) >> _U(24)).astype(np.int64)
            new, id_ = np.full(registers, np.inf), np.zeros(registers, np.uint64)
            new[register], id_[register] = t, p
            better = new < first
            first[better], value[better] = new[better], id_[better]
            if first.max() < enough:
                break
        live = now < first.max()
        streams, rate, low, weight, now = streams[live], rate[live], low[live], weight[live], now[live]
        at += n
    return value


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = x[at] == y
    shared = int(np.minimum(n[at[both]], m[both]).sum())
    return shared / (int(n.sum()) + int(m.sum()) - shared)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("bag", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bag, n, bands): 128 bits of the multiset, its size, and a hash for each band."""

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, key, text in records(arrow):
                items, counts = shingles(text)
                if not len(items):
                    yield doc_id, key, None, 0, []
                    continue
                bands = bag_min_hash(items, counts).reshape(BANDS, ROWS)
                h = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)
                for k in range(ROWS):
                    h = mix(h * _U(3) + bands[:, k])
                yield doc_id, key, xxhash.xxh3_128_digest(items.tobytes() + counts.tobytes()), int(counts.sum()), h.view(np.int64).tolist()

        yield from batches(rows(), _SKETCH)

    return docs.mapInArrow(run, "doc_id long, key long, bag binary, n long, bands array<long>")


_SIM = pa.schema([("d", pa.struct([("doc_id", pa.int64()), ("key", pa.int64())])), ("e", pa.struct([("doc_id", pa.int64()), ("key", pa.int64())])), ("similarity", pa.float64())])


def _compare(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        lead, own = None, None
        for leads, d, e, text in records(arrow, 32):
            if leads:
                lead, own = e, shingles(text)
            else:
                yield d, lead, weighted_jaccard(own, shingles(text))

    yield from batches(rows(), _SIM)


def similarities(pairs: DataFrame, texts: DataFrame, spread: int = 256) -> DataFrame:
    """(d, e, similarity) of (d, e) pairs: e's text travels once for each `spread` of its partners.

    A pair that repeats gives as many rows; one without words on a side has similarity 0; a node that `texts` lacks, or a
    null one, gives no row; no pairs give no rows.
    """
    few = pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS  # a few pairs go to the texts, not the texts to them
    hint = F.broadcast if few else (lambda x: x)
    pairs = hint(pairs.select("d", "e"))
    groups = pairs.groupBy("e").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / spread).cast("int"))
    groups = hint(groups)
    later = hint(pairs.join(groups, "e")).withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts").cast("long")).cast("int")).join(texts, "d").select("e", "part", F.lit(0).alias("leads"), "d", "text")
    lead = groups.join(texts.withColumnRenamed("d", "e"), "e").select("e", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("leads"), F.col("e").alias("d"), "text")
    met = later.union(lead).repartition("e", "part").sortWithinPartitions("e", "part", F.desc("leads"))
    return met.select("leads", "d", "e", "text").mapInArrow(_compare, f"d {_NODE}, e {_NODE}, similarity double")


#: Bins of a coarse signature, one byte each, and how far under the threshold its estimate may be: four standard deviations.
BINS, SLACK = 128, 0.15
_COARSE = pa.schema([("d", pa.struct([("doc_id", pa.int64()), ("key", pa.int64())])), ("coarse", pa.binary())])


def coarse(items: np.ndarray) -> bytes:
    """One byte of the least hash of each of BINS parts of a set; 0 for an empty part."""
    least = np.full(BINS, 2**64 - 1, np.uint64)
    np.minimum.at(least, (items >> _U(57)).astype(np.int64), items << _U(7))
    return np.where(least < 2**64 - 1, (least >> _U(20)) % _U(255) + _U(1), _U(0)).astype(np.uint8).tobytes()


def similar_pairs(pairs: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(d, e, similarity) of the (d, e) pairs whose texts have the similarity; nodes are (doc_id, key) structs, null ids last.

    All pairs are first estimated from coarse signatures of 128 bytes, so that texts travel for those alone that may
    pass: one in 10,000 of similarity 0.8 is lost by that.  Texts without words are like no other; no pairs give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text_key(text).alias("key")).alias("d"), text.alias("text"))

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((d, coarse(shingles(t)[0])) for d, t in records(arrow)), _COARSE)

    signed = checkpointed(texts.mapInArrow(run, f"d {_NODE}, coarse binary"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, BINS) for z in (a, b))
        same, any_ = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
        return pd.Series(same >= (threshold - SLACK) * np.maximum(any_, 1))

    pairs = pairs.join(signed, "d").withColumnRenamed("coarse", "a").join(signed.select(F.col("d").alias("e"), F.col("coarse").alias("b")), "e")
    likely = checkpointed(pairs.where(near("a", "b")).select("d", "e").distinct())
    return similarities(likely, texts).where(F.col("similarity") >= threshold)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in `links` (d, e): the smallest node of its connected component.

    Alternating large-star and small-star rounds, each a grouped minimum and a join, until nothing changes; every
    round is checkpointed.  A link that repeats counts once, one of a node to itself for nothing; nulls don't occur;
    without links there are no rows.  A node of very many links meets them in several tasks.
    """
    edges = checkpointed(links.select(F.greatest("d", "e").alias("u"), F.least("d", "e").alias("v")).where("u != v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = counted_join(both, checkpointed(low), "u", F.col("v"), hot=HUB) if state[0] > LINKS else both.join(low, "u")
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u != v").distinct())


def buckets(rows: DataFrame) -> DataFrame:
    """(d, h) rows of the buckets `h` with several nodes, with their size `n` and leader `e`.

    The leader is the node with the most company over all its buckets: of a family of copies, one near their origin.
    """
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = checkpointed(counted_join(rows, checkpointed(shared), "h", F.col("d")).select("d", "h", "n"))
    company = rows.groupBy("d").agg(F.sum("n").alias("company"))
    large = rows.where(f"n > {SMALL_BUCKET}")
    leader = large.join(company, "d").groupBy("h").agg(F.min(F.struct(-F.col("company"), F.col("d").alias("d"))).alias("x"), F.max("n").alias("held"))
    led = counted_join(large, checkpointed(leader.select("h", "held", F.col("x.d").alias("e"))), "h", F.col("d"), "held")
    few = rows.where(f"n <= {SMALL_BUCKET}").select("d", "h", "n", F.lit(None).cast(_NODE).alias("e"))
    return checkpointed(few.union(led.select("d", "h", "n", "e")))


_PAIR = pa.struct([("doc_id", pa.int64()), ("key", pa.int64())])


def _forest(threshold: float):
    """Links between the asking rows of a block and the others, as many as join classes."""

    def run(table: pa.Table) -> pa.Table:
        d, asks = table.column("d").to_pylist(), table.column("asks").to_numpy()
        root = table.column("root").to_pylist()
        sets = [_occurrences(*shingles(t)) for t in table.column("text").to_pylist()]
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(d), -1)
        other = np.flatnonzero(asks == 0).tolist()
        sizes = np.array([len(sets[k]) for k in other], np.int64)
        items, place = np.unique(np.concatenate([sets[k] for k in other] or [np.zeros(0, np.uint64)]), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        up = {r: r for r in root}

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        left, right = [], []
        theirs = bands[other]
        for k in np.flatnonzero(asks == 1).tolist() if other else ():
            own = np.zeros(len(items), bool)
            at = np.minimum(np.searchsorted(items, sets[k]), len(items) - 1)
            own[at[items[at] == sets[k]]] = True
            shared = np.add.reduceat(own[place], starts, dtype=np.int64)
            near = np.flatnonzero(shared / (sizes + len(sets[k]) - shared) >= threshold)
            for j in near[(theirs[near] == bands[k]).any(1)].tolist():
                a, b = find(root[k]), find(root[other[j]])
                if a != b:
                    up[a] = b
                    left.append(d[k])
                    right.append(d[other[j]])
        return pa.table({"d": pa.array(left, _PAIR), "e": pa.array(right, _PAIR)})

    return run


def _occurrences(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: of a shingle's occurrences each has a hash of its own."""
    if counts.max(initial=0) < 2:
        return items
    first = np.cumsum(counts) - counts
    turn = (np.arange(int(counts.sum())) - np.repeat(first, counts)).astype(np.uint64)
    return np.unique(mix(np.repeat(items, counts) + turn * _U(0xA0761D6478BD642F)) * (turn > 0) + np.repeat(items, counts) * (turn == 0))


def links_between_classes(large: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(d, e) links that join classes which meet in large buckets: of those of one leader, each node outside its class meets all.

    Both sides are dealt into blocks of about BLOCK nodes; a block gives fewer links than it has nodes.
    """
    group = large.select("e", "d").distinct()
    named = group.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    lead = named.where("d = e").select("e", F.col("root").alias("lead"))
    named = checkpointed(named.join(lead, "e").select("e", "d", F.xxhash64("root").alias("root"), (F.col("root") != F.col("lead")).alias("asks")))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = named.groupBy("e").agg(blocks(F.count(F.lit(1))).alias("held"), blocks(F.count(F.when(F.col("asks"), 1))).alias("asking")).where("asking > 0")
    rows = named.join(small(checkpointed(sizes)), "e").withColumn("hash", F.xxhash64("d"))
    own, every = lambda n: F.pmod("hash", F.col(n).cast("long")).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rows.where("asks").select("e", "d", "root", own("asking").alias("i"), every("held").alias("j"), F.lit(1).alias("asks"))
    met = rows.select("e", "d", "root", every("asking").alias("i"), own("held").alias("j"), F.lit(0).alias("asks"))
    rows = asks.union(met).join(texts, "d").select("e", "i", "j", "asks", "d", "root", "text", "bands")
    return rows.groupBy("e", "i", "j").applyInArrow(_forest(threshold), f"d {_NODE}, e {_NODE}").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, key, n_shingles, class_id, class_key): one row for each distinct (doc_id, text) of `docs`.

    class_id is the smallest doc_id of the class (null last), class_key tells apart texts that share it.  Null texts
    are empty; a text without words is alone in its class; a text of one to four words is one shingle, so only
    equal ones meet.  Repeated rows are one; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    sketched = checkpointed(sketches(rows).dropDuplicates(["doc_id", "key"]))
    nodes = sketched.where("n > 0").select(F.struct("doc_id", "key").alias("d"), "bag", "bands")
    heads = nodes.groupBy("bag").agg(F.min(F.struct("d", "bands")).alias("x")).select("bag", "x.d", "x.bands")
    held = buckets(heads.select("d", F.explode("bands").alias("h")))
    texts = rows.select(F.struct("doc_id", "key").alias("d"), "text")
    texts = checkpointed(texts.join(heads.select("d", "bands").join(held.select("d").distinct(), "d"), "d").dropDuplicates(["d"]))
    few, large = held.where(f"n <= {SMALL_BUCKET}").select("h", "d"), held.where(f"n > {SMALL_BUCKET}")
    pairs = few.join(few.withColumnRenamed("d", "e"), "h").where("e < d").select("d", "e")
    pairs = checkpointed(pairs.union(large.where("d != e").select("d", "e")).distinct())
    known = checkpointed(similarities(pairs, texts))
    links = known.where(F.col("similarity") >= threshold).select("d", "e")
    roots = components(links)
    more = checkpointed(links_between_classes(large, roots, texts, threshold))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("d"), F.col("root").alias("e")).union(more))
    classes = heads.select("bag", F.col("d").alias("node")).join(roots, "node", "left").select("bag", F.coalesce("root", "node").alias("root"))
    out = sketched.select("doc_id", "key", "n", "bag").join(classes, "bag", "left")
    null_id = lambda c: F.nullif(c, F.lit(2**63 - 1))
    return out.select(null_id(F.col("doc_id")).alias("doc_id"), "key", F.col("n").alias("n_shingles"), null_id(F.coalesce("root.doc_id", "doc_id")).alias("class_id"), F.coalesce("root.key", "key").alias("class_key"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, unchanged whatever its columns' names; texts without words all stay, once each."""
    last = F.lit(2**63 - 1)
    first = near_duplicates(docs.select("doc_id", "text"), threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    first = first.select(F.coalesce("doc_id", last).alias("own"), F.col("key").alias("hash"))
    rows = packed(docs, own=F.coalesce(F.col("doc_id").cast("long"), last), hash=text_key(F.col("text").cast("string")))
    return unpacked(rows.join(first, ["own", "hash"], "left_semi").dropDuplicates(["own", "hash"]), docs)
