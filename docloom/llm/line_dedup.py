"""Line dedup by pairwise alignment.

A block of a document is a run of lines with `min_chars` characters at least (blank lines don't count, white space at
either end of a line neither).  Each line is held by two least blocks, the one that begins with it and the one that
ends with it: one and the same for a line that is long enough by itself.  A least block leads from each document that
holds it to the first one that does, so overlapping documents meet through hashes of rare and frequent lines alike,
a line has at most two partners, and a run that two documents share can't be missed: it contains a least block of each
of its lines, whoever their first holders are.

A document is aligned with each of its partners by patience diff: blocks that are unique on both sides and their
longest increasing run, then the same between neighbouring anchors, where a block may be unique again; where none is,
its occurrences are counted off.  The lines of aligned blocks are deleted from the later document.  Blocks that this
leaves, as they stand in another order there, have moved: each is aligned by itself, unless `moved` is false.  So what
one partner holds goes whatever the order, and no other document that holds it has to be tried: a line is deleted if
and only if a block of it stands in an earlier document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, batches, checkpointed, counted_join, packed, records, text_key, unpacked

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LAST = 2**63 - 1
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2 ** 64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in _BASES:
            for b in (base, pow(base, -1, 2**64)):
                x = np.full(max(1024, 2 * n), b, np.uint64)
                x[0] = 1
                _powers.append(np.multiply.accumulate(x))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def least_blocks(text: str, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, first line, number of lines) of a text's least blocks in order; the last two count blank lines."""
    at, size, low, high = [], [], [], []
    for k, line in enumerate(text.split("\n")):
        line = line.strip(SPACE)
        if line:
            x = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
            at.append(k)
            size.append(len(line))
            low.append(x & (2**64 - 1))
            high.append(x >> 64)
    n = len(at)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    if total[-1] < min_chars:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64))  # type: ignore[return-value]
    stop = np.searchsorted(total, total[:n] + min_chars)  # of the block that begins with each line
    start = np.searchsorted(total, total[1:] - min_chars, "right") - 1  # of the block that ends with each line
    ok, ends = stop <= n, total[1:] >= min_chars
    code = np.unique(np.concatenate([np.arange(n)[ok] * (n + 1) + stop[ok], start[ends] * (n + 1) + np.arange(1, n + 1)[ends]]))
    start, stop = code // (n + 1), code % (n + 1)
    power = _power(n + 1)
    hashes = []
    for lines, up, down in ((low, power[0], power[1]), (high, power[2], power[3])):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(lines, np.uint64) * up[:n])])
        hashes.append(_mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
    where = np.array(at, np.int64)
    return hashes[0].view(np.int64), (hashes[1] >> _U(33)).astype(np.int32), where[start], where[stop - 1] + 1 - where[start]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j), increasing in both, of equal elements a[i] == b[j].

    Elements that are unique in both are anchored by their longest increasing run; the gaps between anchors are aligned
    by themselves, as more elements are unique there.  Where none is, the n-th occurrence in `a` stands for the n-th in `b`.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
        if not anchors and in_a.keys() & in_b.keys():
            turns = {x: [] for x in in_a.keys() & in_b.keys()}
            for j in range(b0, b1):
                if b[j] in turns:
                    turns[b[j]].append(j)
            turn: Counter = Counter()
            for i in range(a0, a1):
                if a[i] in turns:
                    if turn[a[i]] < len(turns[a[i]]):
                        anchors.append((i, turns[a[i]][turn[a[i]]]))
                    turn[a[i]] += 1
        run = increasing(anchors)
        out += run
        if run:
            gaps += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)])]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of `pairs`, in order of their first members, whose second members increase."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(met: list[tuple[int, int, int]], moved: bool) -> set[int]:
    """The lines of a document that one partner holds: `met` has (first line here, first line there, lines) of the shared blocks.

    A block stands for an element of both sequences; it may be at several places here, and is at its first one there.
    """
    met = sorted(set(met))
    a = [there for _, there, _ in met]  # a block is named by its place there
    found = [i for i, _ in patience(a, sorted(set(a)))]
    gone = {k for i in found for k in range(met[i][0], met[i][0] + met[i][2])}
    if moved:
        for here, there, n in met:
            if not gone.issuperset(range(here, here + n)):
                gone.update(range(here, here + n))
    return gone


_BLOCKS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("h", pa.list_(pa.int64())), ("c", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("lines", pa.list_(pa.int32()))])
_NODE = [("doc_id", pa.int64()), ("key", pa.int64())]
_CUT = pa.schema([*_NODE, ("lines", pa.list_(pa.int32())), ("partner", pa.struct(_NODE)), ("others", pa.list_(pa.int32()))])
CUT = "doc_id long, key long, lines array<int>, partner struct<doc_id:bigint,key:bigint>, others array<int>"


def _blocks(min_chars: int):
    def batch(held: list[tuple]) -> pa.RecordBatch:
        ids, keys, *parts = zip(*held)
        starts = pa.array(np.cumsum([0, *map(len, parts[0])]), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x), f.type.value_type)) for x, f in zip(parts, list(_BLOCKS)[2:])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *lists], schema=_BLOCKS)

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for doc_id, key, text in records(arrow, 64):
            own = least_blocks(text or "", min_chars)
            if len(own[0]):
                held.append((doc_id, key, *own))
                n += len(own[0])
            if n >= 50_000:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return run


def _align(moved: bool):
    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, key, first, here, there, lines in records(arrow, 64):
                partners: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for e, *block in zip(first, here, there, lines):
                    partners.setdefault((e["doc_id"], e["key"]), []).append(tuple(block))
                gone = {e: aligned(met, moved) for e, met in sorted(partners.items())}
                best = max(gone, key=lambda e: len(gone[e]))
                others = set().union(*(lines for e, lines in gone.items() if e != best))
                yield doc_id, key, sorted(others | gone[best]), {"doc_id": best[0], "key": best[1]}, sorted(others)

        yield from batches(rows(), _CUT)

    return run


def aligned_lines(docs: DataFrame, min_chars: int = 32, moved: bool = True) -> DataFrame:
    """(doc_id, key, lines, partner, others): the line numbers to delete from each document that has any, which document holds most of them, and those that others hold.

    Blocks are told apart by 95 bits.  All that travels is a few numbers for each line, whatever documents hold it: a
    frequent line sends each of its holders to one partner, and a document gathers its own blocks only.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    kinds = "doc_id long, key long, h array<long>, c array<int>, at array<int>, lines array<int>"
    blocks = checkpointed(rows.mapInArrow(_blocks(min_chars), kinds))
    held = blocks.select("doc_id", "key", F.explode(F.arrays_zip("h", "c", "at", "lines")).alias("b"))
    held = held.select(F.struct("doc_id", "key").alias("d"), F.struct("b.h", "b.c").alias("block"), F.col("b.at").alias("here"), "b.lines")
    shared = held.groupBy("block").agg(F.min(F.struct("d", "here")).alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first.d != last")
    shared = checkpointed(shared.select("block", F.col("first.d").alias("e"), F.col("first.here").alias("there"), "n"))
    met = counted_join(held, shared, "block", F.col("d")).where("d != e")
    met = met.groupBy("d").agg(F.collect_list(F.struct("e", "here", "there", "lines")).alias("b"))
    return met.select("d.doc_id", "d.key", "b.e", "b.here", "b.there", "b.lines").mapInArrow(_align(moved), CUT)


def dedup_lines(docs: DataFrame, cut: DataFrame | None = None, **parameters) -> DataFrame:
    """The rows of `docs` with `text` without the deleted lines, and `_n_lines`, `_n_removed`, `_n_chars` and `_n_left`.

    Earlier means a smaller doc_id (null last), then a smaller hash of the text; rows alike in both are one document
    and are treated alike.  A line stays in the first document that holds it.  Blank lines go with the lines on both
    sides of them.  `_n_chars` counts the text's characters without white space, `_n_left` those that are left.  Null texts stay null; an empty
    text is one blank line; texts of fewer than `min_chars` characters stay; an empty table gives no rows; other columns
    are carried through, but for those named like the four results.  `cut` gives the lines, where they are known.
    """
    cut = aligned_lines(docs.select("doc_id", "text"), **parameters) if cut is None else cut
    cut = cut.select(F.col("doc_id").alias("own"), F.col("key").alias("hash"), F.col("lines").alias("cut"))
    text = F.col("text").cast("string")
    rows = packed(docs, own=F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), hash=text_key(text))
    rows = rows.join(cut, ["own", "hash"], "left").withColumn("lines", F.split(F.col("row.text").cast("string"), "\n"))
    # A set of line numbers as runs between them: the k-th piece is what stands between two deleted lines.
    rows = rows.withColumn("edges", F.concat(F.array(F.lit(-1)), "cut", F.array(F.size("lines"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cut") + 1), lambda k: F.slice(F.col("lines"), F.element_at("edges", k) + 2, F.element_at("edges", k + 1) - F.element_at("edges", k) - 1)))
    text = F.col("row.text").cast("string")
    rows = rows.withColumn("text", F.when(F.col("cut").isNull(), text).otherwise(F.array_join(kept, "\n")))
    solid = lambda c: F.length(F.translate(F.coalesce(c, F.lit("")), SPACE, "")).cast("long")
    return unpacked(rows, docs, text=F.col("text"), _n_lines=F.coalesce(F.size("lines"), F.lit(0)), _n_removed=F.coalesce(F.size("cut"), F.lit(0)), _n_chars=solid(text), _n_left=solid(F.col("text")))
