"""Suffix dedup by bucket-pointer refinement, distributed.

What is asked of every 50-byte string is the smallest document in which it starts.  All 50-byte strings of a corpus
are far too many to shuffle, so they meet through their keys: a string's key is the smallest hash of its q-grams,
and neighbouring strings mostly share it, so that one stretch of text (a context) stands for about ten strings.

1. Documents are dealt into blocks.  Each block sends its distinct keys, each with a fingerprint of its context,
   to the keys' shards.
2. A shard answers which keys occur elsewhere, and whether always in the same context.
3. Of a key with one context a block sends its smallest document only.  Of a key with several it sends each distinct
   context; if the key is in many blocks (hot), each 50-byte string by itself, to a shard by its own hash, so no
   shard gathers all that surrounds a frequent key.
4. A shard refines suffix buckets of the contexts: buckets of 8-grams hold bucket pointers, and sorting by the
   pointers at later offsets (8, 16, then 18) splits them to depth 50, each level reusing the one before.  Only
   buckets of several suffixes are sorted.  It answers, where a string starts in a smaller document, in which.
5. Blocks mark the bytes that such strings cover.

Step 2 takes contexts for different where 32 bits differ.  Before anything is removed for an equal context, 112 bits of
it have to agree, so that of 10 ** 13 contexts a pair is taken for equal wrongly with a chance of 1 in 10 ** 8; all
other strings are compared byte by byte, by refinement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_key

LENGTH, GRAM = 50, 24
#: A key with several contexts in so many blocks is hot: its strings are dealt one by one.
HOT_BLOCKS = 64
#: Bytes of contexts that are refined at once (those of one key stay together), and of text that is hashed at once.
REFINE_BYTES, HASH_BYTES = 1_000_000, 1 << 16
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
ALONE, ONE_CONTEXT, SEVERAL, HOT = range(4)
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def window_keys(data: bytes) -> np.ndarray:
    """The 48-bit key of each LENGTH-byte string: the least hash of its GRAM-byte strings, mixed again to be even."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    h = word[:n] * _U(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> _U(31)
        h += word[k : k + n]
        h *= _U(0xC2B2AE3D27D4EB4F)
    h = _mix(h)
    width, want = 1, LENGTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return h


_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the fingerprints and of its inverse, modulo 2 ** 64."""
    size = 1 << max(17, (n - 1).bit_length())
    if size not in _power:
        both = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _power.clear()
        _power[size] = tuple(both)
    return _power[size]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of equal neighbours."""
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(16)) * _U(shards) >> _U(32)).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys in about four bytes each: the low halves, after counts of the high ones."""
    high = (keys >> _U(32)).astype(np.int64)
    counts = np.bincount(high - high[0]).astype(np.uint32)
    return np.array([high[0], len(counts)], np.uint32).tobytes() + counts.tobytes() + keys.astype(np.uint32).tobytes()


def unpack(data: bytes) -> np.ndarray:
    first, n = np.frombuffer(data, np.uint32, 2).tolist()
    counts = np.frombuffer(data, np.uint32, n, 8)
    return np.repeat(np.arange(first, first + n).astype(np.uint64) << _U(32), counts) | np.frombuffer(data, np.uint32, -1, 8 + 4 * n)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as what they have above the least, in four bytes each where that is enough."""
    low = int(ids.min())
    above = (ids.view(np.uint64) - _U(low % 2**64)).astype(np.uint64)
    kind = np.uint32 if int(above.max()) < 2**32 else np.uint64
    return np.array([low, np.dtype(kind).itemsize], np.int64).tobytes() + above.astype(kind).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    low, size = np.frombuffer(data, np.int64, 2).tolist()
    above = np.frombuffer(data, np.uint32 if size == 4 else np.uint64, -1, 16).astype(np.uint64)
    return (above + _U(low % 2**64)).view(np.int64)


def refine_buckets(contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each context, for each of its LENGTH-byte strings, the smallest of `docs` whose context holds that string."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = b"".join(contexts) + bytes(8)
    n = len(text) - 8
    stop = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    first = np.ndarray((n,), "<u8", text, 0, (1,)).copy()
    pointer = np.empty(n, np.int64)
    order = np.argsort(first, kind="stable")
    lead = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    pointer[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]  # a bucket's pointer is its first suffix
    for depth, offset in ((16, 8), (32, 16), (LENGTH, LENGTH - 32)):
        many = np.bincount(pointer, minlength=n)[pointer] > 1
        own = at[many & (at + depth <= stop)]  # a suffix too short for this depth keeps its pointer, and isn't asked for later
        if not len(own):
            continue
        key = pointer[own] * n + pointer[own + offset]
        order = np.argsort(key, kind="stable")
        lead = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        pointer[own[order]] = own[order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
    owner = np.repeat(np.arange(len(contexts)), sizes)
    whole = at + LENGTH <= stop
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, pointer[whole], docs[owner[whole]])
    got = least[pointer]
    starts = np.cumsum(sizes) - sizes
    return [got[s : s + k - LENGTH + 1] for s, k in zip(starts.tolist(), sizes.tolist())]


def _no_runs() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32))


class Block:
    """The documents of one block in order of doc_id, and the runs of equal keys in them.

    Runs are sorted by key, those of a key by document.  An entry is a stretch of runs alike in key and fingerprint.
    """

    def __init__(self, table: pa.Table, shards: int):
        self.shards, self.number = shards, table.column("block")[0].as_py()
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("data").to_pylist()), key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([len(r[1]) for r in rows], np.int64)
        self.data = b"".join(r[1] for r in rows)
        parts = [_no_runs()]
        ends = np.cumsum(self.sizes)
        low = 0
        while low < len(rows):  # documents are hashed some at a time
            start = int(ends[low] - self.sizes[low])
            high = max(low + 1, int(np.searchsorted(ends, start + HASH_BYTES, "right")))
            parts.append(self._runs(start, self.sizes[low:high], low))
            low = high
        columns = list(zip(*parts))
        del parts, rows
        key = np.concatenate(columns.pop(0))
        order = np.argsort(key, kind="stable")
        key = key[order]
        fingerprint, self.start, self.n, self.doc = (np.concatenate(columns.pop(0))[order] for _ in range(4))
        del order
        lead = np.ones(len(key), bool)
        lead[1:] = (key[1:] != key[:-1]) | (fingerprint[1:] != fingerprint[:-1])
        self.entry = np.flatnonzero(lead)
        self.width = np.diff(np.append(self.entry, len(key)))
        self.keys, fingerprint = key[self.entry], fingerprint[self.entry]
        self.fingerprints, self.checks = (fingerprint >> _U(32)).astype(np.uint32), fingerprint.astype(np.uint32)
        self.cuts = np.searchsorted(shard_of(self.keys, shards), np.arange(shards + 1))

    def _runs(self, start: int, sizes: np.ndarray, doc: int) -> tuple[np.ndarray, ...]:
        """Keys, fingerprints, starts, numbers of strings and documents of the runs in some documents."""
        data = self.data[start : start + int(sizes.sum())]
        keys = window_keys(data)
        if not len(keys):
            return _no_runs()
        stop = np.repeat(np.cumsum(sizes), sizes)[: len(keys)]
        keys[np.arange(LENGTH, LENGTH + len(keys)) > stop] = 2**64 - 1  # strings across documents
        low, high = runs(keys)
        ok = keys[low] != 2**64 - 1
        low, high = low[ok], high[ok]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8) + _U(1)) * up[: len(data)], out=total[1:])
        fingerprint = _mix((total[high - 1 + LENGTH] - total[low]) * down[low])
        key = ((keys[low] ^ (keys[low] >> _U(31))) * _U(0xBF58476D1CE4E5B9)) >> _U(16)
        owner = doc + np.repeat(np.arange(len(sizes)), sizes)[low]
        return key, fingerprint, low + start, (high - low).astype(np.int32), owner.astype(np.int32)

    def by_shard(self) -> Iterable[tuple[int, int, int]]:
        """(shard, first entry, end of entries) of each shard that has entries."""
        return ((s, a, b) for s, (a, b) in enumerate(zip(self.cuts.tolist(), self.cuts[1:].tolist())) if b > a)

    def learn(self, answers: list[dict]) -> None:
        """Take the shards' answers on this block's entries."""
        self.kind = np.zeros(len(self.keys), np.uint8)
        for r in answers:
            if r["kind"] == 0:
                self.kind[self.cuts[r["shard"]] : self.cuts[r["shard"] + 1]] = np.frombuffer(r["a"], np.uint8)
        self.single = np.flatnonzero(self.kind == ONE_CONTEXT)
        self.single_cuts = np.searchsorted(self.single, self.cuts)

    def contexts(self) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Of keys with several contexts: the distinct contexts, their keys, their smallest documents, and (context, start, doc) of each."""
        run = np.repeat(self.kind, self.width)
        which = np.flatnonzero(run >= SEVERAL)
        which = which[np.argsort(self.doc[which], kind="stable")]
        key = np.repeat(self.keys, self.width)[which]
        number: dict[bytes, int] = {}
        keys: list[int] = []
        least: list[int] = []
        places: list[tuple[int, int, int]] = []
        for start, n, k, doc, kind in zip(self.start[which].tolist(), self.n[which].tolist(), key.tolist(), self.ids[self.doc[which]].tolist(), run[which].tolist()):
            for a, b in ((i, i + LENGTH) for i in range(start, start + n)) if kind == HOT else ((start, start + n - 1 + LENGTH),):
                context = self.data[a:b]
                c = number.setdefault(context, len(number))
                if c == len(keys):
                    keys.append(int.from_bytes(hashlib.blake2b(context, digest_size=6).digest(), "little") if kind == HOT else k)
                    least.append(doc)
                places.append((c, a, doc))
        return list(number), np.array(keys, np.uint64), np.array(least, np.int64), places


def _by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Numbers of each shard's keys, in order."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


_KEYS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary()), ("many", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("kind", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ASK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])
KEYS, ANSWER = "shard long, block long, keys binary, prints binary, many binary", "block long, shard long, kind long, a binary, b binary"
ASK, RESULT = "shard long, block long, keys binary, docs binary, sizes binary, data binary", "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _send_keys(shards: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table, shards)
        return _table([(s, b.number, pack(b.keys[x:y]), b.fingerprints[x:y].tobytes(), np.packbits(b.width[x:y] > 1).tobytes()) for s, x, y in b.by_shard()], _KEYS)

    return run


def _answer_keys(hot_blocks: int):
    def run(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        parts = [unpack(r["keys"]) for r in own]
        sizes = [len(p) for p in parts]
        keys = np.concatenate(parts)
        prints = np.concatenate([np.frombuffer(r["prints"], np.uint32) for r in own])
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n) for r, n in zip(own, sizes)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        start, stop = runs(keys[order])
        p = prints[order]
        differs = np.zeros(len(p), np.int64)
        differs[1:] = p[1:] != p[:-1]
        differs[start] = 0
        several = np.add.reduceat(differs, start) > 0
        shared = (stop - start > 1) | (np.add.reduceat(many[order].astype(np.int64), start) > 0)
        kind = np.where(several, np.where(stop - start >= hot_blocks, HOT, SEVERAL), np.where(shared, ONE_CONTEXT, ALONE)).astype(np.uint8)
        told = np.empty(len(keys), np.uint8)
        told[order] = np.repeat(kind, stop - start)
        cuts = np.cumsum([0, *sizes]).tolist()
        return _table([(r["block"], r["shard"], 0, told[a:b].tobytes(), None) for r, a, b in zip(own, cuts, cuts[1:]) if told[a:b].any()], _ANSWER)

    return run


def _send_contexts(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _ASK.empty_table()
        b, out = Block(table, shards), []
        b.learn(answers.to_pylist())
        cuts = b.single_cuts.tolist()
        for s, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                own = b.single[x:y]
                out.append((s, b.number, pack(b.keys[own]), pack_ids(b.ids[b.doc[b.entry[own]]]), None, b.checks[own].tobytes()))
        texts, keys, least, _ = b.contexts()
        for s, own in enumerate(_by_shard(keys, shards)):
            if len(own):
                mine = [texts[i] for i in own.tolist()]
                out.append((s, b.number, keys[own].tobytes(), least[own].tobytes(), np.array([len(x) for x in mine], np.int32).tobytes(), b"".join(mine)))
        return _table(out, _ASK)

    return run


def _answer_contexts(refined: bool):
    def run(table: pa.Table) -> pa.Table:
        """Kind 1: entries of one context that start in a smaller document; kind 2: where strings of a context do."""
        rows = table.to_pylist()
        out = []
        single = [r for r in rows if r["sizes"] is None]
        if single:
            parts = [unpack(r["keys"]) for r in single]
            keys, checks = np.concatenate(parts), np.concatenate([np.frombuffer(r["data"], np.uint32) for r in single])
            docs = np.concatenate([unpack_ids(r["docs"]) for r in single])
            order = np.lexsort((docs, checks, keys))
            lead = np.ones(len(order), bool)
            lead[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
            low, at = np.empty(len(docs), np.int64), 0
            low[order] = docs[order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
            for r, p in zip(single, parts):
                hit = np.flatnonzero(low[at : at + len(p)] < docs[at : at + len(p)])
                if len(hit):
                    out.append((r["block"], r["shard"], 1, hit.astype(np.uint32).tobytes(), low[at + hit].tobytes()))
                at += len(p)
        return _table(out + _answer_several([r for r in rows if r["sizes"] is not None], refined), _ANSWER)

    return run


def _answer_several(rows: list[dict], refined: bool) -> list[tuple]:
    asked, least, text, keys = [], [], [], []
    number: dict[bytes, int] = {}
    for r in rows:
        sizes, docs, own = np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["docs"], np.int64), np.frombuffer(r["keys"], np.uint64)
        ends = np.cumsum(sizes).tolist()
        ids = []
        for a, b, doc, key in zip([0, *ends], ends, docs.tolist(), own.tolist()):
            context = r["data"][a:b]
            n = number.setdefault(context, len(number))
            if n == len(text):
                text.append(context)
                least.append(doc)
                keys.append(key)
            elif doc < least[n]:
                least[n] = doc
            ids.append(n)
        asked.append((r["block"], r["shard"], docs, np.array(ids, np.int64)))
    if not asked:
        return []
    key, low = np.array(keys, np.uint64), np.array(least, np.int64)
    order = np.argsort(key, kind="stable")
    start, stop = runs(key[order])
    many = [(a, b) for a, b in zip(start.tolist(), stop.tolist()) if b - a > 1 and refined]
    parts: dict[int, np.ndarray] = {}
    batch: list[int] = []
    size = 0
    for k, (a, b) in enumerate(many):
        batch += order[a:b].tolist()
        size += sum(len(text[i]) for i in order[a:b].tolist())
        if size >= REFINE_BYTES or k == len(many) - 1:
            parts.update(zip(batch, refine_buckets([text[i] for i in batch], low[batch])))
            batch, size = [], 0
    out = []
    for block, shard, docs, ids in asked:
        whole = np.flatnonzero(low[ids] < docs)
        told = [np.stack([whole, np.zeros(len(whole), np.int64), np.full(len(whole), 1 << 30), low[ids[whole]]])]
        for i, (n, doc) in enumerate(zip(ids.tolist(), docs.tolist())):
            got = parts.get(n)
            if got is not None and low[n] == doc and (got < doc).any():
                a, b = runs(got)
                hit = got[a] < doc
                told.append(np.stack([np.full(int(hit.sum()), i), a[hit], b[hit], got[a[hit]]]))
        all_ = np.concatenate(told, axis=1)
        if all_.shape[1]:
            out.append((block, shard, 2, all_[:3].astype(np.int32).tobytes(), all_[3].tobytes()))
    return out


def _mark(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT.empty_table()
        b, told = Block(table, shards), answers.to_pylist()
        b.learn(told)
        edge = np.zeros(len(b.data) + 1, np.int32)
        # One context: a string starts in a smaller document if its entry's smallest, here or elsewhere, is smaller.
        least = b.ids[b.doc[b.entry]].copy() if len(b.entry) else np.zeros(0, np.int64)
        for r in told:
            if r["kind"] == 1:
                own = b.single[b.single_cuts[r["shard"]] : b.single_cuts[r["shard"] + 1]]
                least[own[np.frombuffer(r["a"], np.uint32)]] = np.frombuffer(r["b"], np.int64)
        gone = (np.repeat(b.kind, b.width) == ONE_CONTEXT) & (np.repeat(least, b.width) < b.ids[b.doc]) if len(b.entry) else np.zeros(0, bool)
        np.add.at(edge, b.start[gone], 1)
        np.add.at(edge, b.start[gone] + b.n[gone] - 1 + LENGTH, -1)
        texts, keys, low, places = b.contexts()
        own = _by_shard(keys, shards)
        from_to: dict[int, list[tuple[int, int, int]]] = {}
        for r in told:
            if r["kind"] == 2:
                i, x, y = np.frombuffer(r["a"], np.int32).reshape(3, -1)
                for c, p, q, doc in zip(own[r["shard"]][i].tolist(), x.tolist(), y.tolist(), np.frombuffer(r["b"], np.int64).tolist()):
                    from_to.setdefault(c, []).append((p, q, doc))
        for c, at, doc in places:
            if low[c] < doc:
                edge[at] += 1
                edge[at + len(texts[c])] -= 1
            else:
                for p, q, smaller in from_to.get(c, ()):
                    if smaller < doc:
                        edge[at + p] += 1
                        edge[at + min(q, len(texts[c]) - LENGTH + 1) - 1 + LENGTH] -= 1
        cover = np.cumsum(edge[:-1]) > 0
        out, at = [], 0
        for doc_id, n in zip(b.ids.tolist(), b.sizes.tolist()):
            mask, data = cover[at : at + n], b.data[at : at + n]
            at += n
            if not mask.any():
                out.append((doc_id, n, 0, 0, data, []))
                continue
            turn = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            out.append((doc_id, n, n - len(kept), len(turn) // 2, kept, turn.tolist()))
        return _table(out, _RESULT)

    return run


def remove_repeats(docs: DataFrame, blocks: int | None = None, hot_blocks: int = HOT_BLOCKS, refined: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (start, stop, ...): one row per input row.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller doc_id; rows
    that share a doc_id are no reason to remove anything from each other.  A null doc_id is larger than all others;
    a null text is an empty one; texts under 50 bytes stay whole; an empty table gives no rows; other columns are
    ignored.  A block has about BLOCK_BYTES, more only if one document has: so a task's memory, some fifteen times
    that, doesn't grow with the input.  `blocks` sets their number instead.  Without `refined`, strings that contexts of
    one key have in common are missed unless the contexts are equal: it shows what refinement decides.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = 2**63 - 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = 0 if blocks else docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    blocks = blocks or max(2 * tasks, -(-held // BLOCK_BYTES))
    tasks = shards = max(tasks, -(-blocks // 2))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), F.encode(text, "UTF-8").alias("data"), F.pmod(F.xxhash64("doc_id", text_key(text)), F.lit(blocks)).alias("block"))
    rows = rows.repartition(tasks, "block")
    answers = rows.groupBy("block").applyInArrow(_send_keys(shards), KEYS).repartition(tasks, "shard").groupBy("shard").applyInArrow(_answer_keys(hot_blocks), ANSWER)
    asked = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_contexts(shards), ASK)
    told = asked.repartition(tasks, "shard").groupBy("shard").applyInArrow(_answer_contexts(refined), ANSWER)
    marked = rows.groupBy("block").cogroup(answers.union(told).groupBy("block")).applyInArrow(_mark(shards), RESULT)
    return marked.withColumn("doc_id", F.nullif("doc_id", F.lit(last)))
