"""Media columns: payload bytes stored as Netpbm or BMP, decoded to numpy, area-resized, tiled as NPY, hashed.

A text becomes an 8-bit grey image 64 samples wide: its UTF-8 bytes, padded with zero bytes to a positive
multiple of 64.  Images with an odd number of rows are stored as binary PGM, the others as 8-bit BMP.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batches, records

WIDTH = 64
_PALETTE = b"".join(bytes((i, i, i, 0)) for i in range(256))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and padded bytes; a null text is an empty one, an empty one is 64 zero bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def write_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, rows from the bottom up, each padded to four bytes."""
    h, w = image.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = image[::-1]
    start = 54 + len(_PALETTE)
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + _PALETTE + rows.tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 with samples of at most 8 bits, comments allowed in the header."""
    at, fields = 2, []
    if data[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a supported Netpbm image")
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    if not 0 < top < 256:
        raise ValueError("samples of more than 8 bits")
    depth = 3 if data[:2] in (b"P3", b"P6") else 1
    if data[:2] in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    else:
        flat = np.array(data[at:].split()[: w * h * depth], np.uint8)
    return flat.reshape((h, w, depth) if depth == 3 else (h, w))


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (through its palette) or 24 bits, in either row order."""
    start, = struct.unpack_from("<I", data, 10)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("unsupported BMP")
    depth, rows = bits // 8, abs(h)
    stride = -(-w * depth // 4) * 4
    flat = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * depth]
    flat = flat[::-1] if h > 0 else flat
    if depth == 3:
        return flat.reshape(rows, w, 3)[:, :, ::-1]
    used, = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, (used or 256) * 4, 14 + head).reshape(-1, 4)[:, :3][:, ::-1]
    grey = bool((palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all())
    return palette[:, 0][flat] if grey else palette[flat]


def read_image(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means over fractional source rectangles, from one integral image of the grey samples."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    h, w = grey.shape
    whole = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def cut(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, low + 1, edge - low

    y0, y1, fy = cut(height, h)
    x0, x1, fx = cut(width, w)
    rows = whole[y0] * (1 - fy)[:, None] + whole[y1] * fy[:, None]
    at = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means is below its right neighbour."""
    tile = np.rint(area_resize(image, 8, 9) * 256).astype(np.int64)
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The area-resized image as the bytes of an NPY file of side x side uint8."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string())])


def _store(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, text in records(arrow):
            n, payload = payload_of(text)
            image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
            media = write_pgm(image) if image.shape[0] % 2 else write_bmp(image)
            image = read_image(media)
            yield doc_id, n, media, npy_tile(image), difference_hash(image)

    yield from batches(rows(), _MEDIA)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (PGM or BMP bytes), tile (NPY bytes), dhash: one row per input row.

    Null and empty texts give a 64-sample black image.  Rows are independent: repeated rows repeat their
    values, an empty table gives no rows, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary, tile binary, dhash string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_crc32", pa.int64())])


def _digest(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, n, media, tile, dhash in records(arrow, 64):
            payload = read_image(media).tobytes()
            yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), dhash, zlib.crc32(np.load(io.BytesIO(tile)).tobytes())

    yield from batches(rows(), _DIGEST)


def media_digests(media: DataFrame) -> DataFrame:
    """Read the stored bytes back and give their digests (see op8 in queries.py)."""
    return media.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_crc32 long")
