"""Byte-level BPE with reuse of content-defined chunks.

A text is cut where a rolling hash of its last bytes has low bits zero, so documents that share a passage share
its chunks wherever the passage stands.  Each distinct chunk is encoded once per task (a bounded store keeps what
was used last) and its ids are reused.  A cut can split a pre-token, so every join is repaired: the text between
the nearest safe boundary before and after the cut is encoded anew and put in place; where a chunk's ids
don't end at such a boundary, what stands between two of them is encoded instead of reused.  A boundary is safe where white space follows
something else: no pre-token spans it and what follows doesn't depend on what stands before.

Ids are those of the vocabulary's own library; the reuse changes no id.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batches, records

#: Cuts fall about every 2 ** CUT_BITS bytes, at least LEAST apart.
CUT_BITS, LEAST, WINDOW = 10, 256, 16
#: Bytes of chunk text that one task keeps, in two generations.
STORE_BYTES = 24_000_000
_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encode and decode with the vocabulary of one tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        refuse_others(spec)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in _byte_chars().items()}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.special = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ranks = {self.bytes_of[i]: i for token, i in vocab.items() if token not in added}
        self.fast = tiktoken.Encoding("own", pat_str=_GPT2, mergeable_ranks=ranks, special_tokens={})
        self.new: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held, self.store_bytes, self.hits = 0, store_bytes, 0

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens, encoded directly."""
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001  the fast encoder panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, data: bytes) -> np.ndarray:
        """Ids of a chunk, encoded once while the store holds it."""
        got = self.new.get(data)
        if got is None:
            got = self.old.get(data)
            if got is None:
                got = np.array(self.plain(data.decode()), np.uint32)
            else:
                self.hits += 1
            if self.held + len(data) > self.store_bytes // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[data] = got
            self.held += len(data)
        else:
            self.hits += 1
        return got

    def segment(self, data: bytes) -> np.ndarray:
        """Ids of UTF-8 text without special tokens: its chunks' ids with every join repaired.  Linear in the text."""
        cuts = cut_points(data)
        if not cuts:
            return self.chunk(data)
        out: list[np.ndarray] = []
        at = 0  # what stands before is encoded
        for start, stop in [*repairs(data, cuts), (len(data), len(data))]:
            if start > at:
                # No cut lies between two repairs, so what does is part of one chunk.
                k = bisect_right(cuts, at)
                low, high = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(data)
                ids = self.chunk(data[low:high])
                ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
                i, j = np.searchsorted(ends, (at - low, start - low)).tolist()
                agrees = ends[i] == at - low and j < len(ends) and ends[j] == start - low
                out.append(ids[i:j] if agrees else self.ids(data[at:start]))  # else no reuse: the boundaries are safe all the same
            if stop > start:
                out.append(self.ids(data[start:stop]))
            at = stop
        return np.concatenate(out)

    def ids(self, data: bytes) -> np.ndarray:
        return np.array(self.plain(data.decode()), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        out = [np.array([self.special[p]], np.uint32) if k % 2 else self.segment(p.encode()) for k, p in enumerate(parts) if p]
        return np.concatenate(out) if out else np.array([], np.uint32)

    def forget(self) -> None:
        """Empty the store: a worker that goes on to other tasks doesn't carry it along."""
        self.new, self.old, self.held = {}, {}, 0

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def refuse_others(spec: dict) -> None:
    """ValueError for a tokenizer file that isn't modelled here: its ids would be wrong silently."""
    model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    asked = {
        "model": model.get("type", "BPE") == "BPE", "normalizer": not spec.get("normalizer"),
        "pre_tokenizer": pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True), "decoder": decoder.get("type") == "ByteLevel",
        **{k: not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if wrong := [k for k, ok in asked.items() if not ok]:
        raise ValueError(f"only plain byte-level BPE files are read; this one differs in {', '.join(wrong)}")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cut_points(data: bytes) -> list[int]:
    """Offsets, on character boundaries, where the hash of the WINDOW bytes before has its low bits zero."""
    n = len(data) - WINDOW
    if n < LEAST:
        return []
    word = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    h = word(0) * np.uint64(0x9E3779B97F4A7C15) + word(8) * np.uint64(0xC2B2AE3D27D4EB4F)
    found = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
    out, last = [], 0
    for at in found.tolist():
        if at - last >= LEAST and len(data) - at >= 8 and data[at] & 0xC0 != 0x80:
            out.append(at)
            last = at
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repairs(data: bytes, cuts: list[int]) -> list[tuple[int, int]]:
    """The stretches to encode anew: from the last safe boundary before each cut to the first after it, joined where they meet.

    Safe is where ASCII white space follows an ASCII byte that isn't white space.  Text without such a place is one
    stretch, so it is encoded once, not once for each cut.
    """
    x = np.frombuffer(data, np.uint8)
    safe = np.concatenate([[0], np.flatnonzero(_IS_SPACE[x[1:]] & (x[:-1] > 32) & (x[:-1] < 127)) + 1, [len(data)]])
    starts, stops = safe[np.searchsorted(safe, cuts) - 1], safe[np.searchsorted(safe, cuts, "right")]
    out: list[tuple[int, int]] = []
    for start, stop in zip(starts.tolist(), stops.tolist()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


_CODES = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; a null text is an empty one and has no ids.

    Rows are independent (repeated rows repeat), an empty table gives no rows, other columns are ignored.  The
    vocabulary file must be at `tokenizer` on every executor.
    """

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        yield from batches(((d, own.encode(t or "").tolist()) for d, t in records(arrow)), _CODES, most_bytes=500_000)
        own.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(codes: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of each array of ids; a null array gives an empty text."""

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        yield from batches(((d, own.decode(ids or ())) for d, ids in records(arrow)), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return codes.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode each whole text in one pass, keeping digests in place of ids and text."""

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)

        def rows() -> Iterator[tuple]:
            for doc_id, text in records(arrow):
                ids = own.encode(text or "").tolist()
                shown = ",".join(map(own.digits.__getitem__, ids))
                yield doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

        yield from batches(rows(), _DIGEST)
        own.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
