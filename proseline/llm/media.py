"""Operator 2, media columns: Netpbm and BMP images as numpy arrays, area-resized, as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import body

WIDTH = 64
#: Height and width of a difference hash's picture: eight comparisons in each of eight rows.
HASH_SHAPE = (8, 9)
TILE_SHAPE = (16, 16)
#: Rows of an image that are summed at once.
STRIP = 1 << 14
_HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 16-bit samples as uint16, bitmaps with 1 for black as 0/1."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        found = re.match(rb"P[14](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)", data)
        top = 1
    else:
        found = _HEADER.match(data)
        top = int(found[4]) if found and found[4] else 0
    if not found or not 0 < top < 65536:
        raise ValueError("not a Netpbm image")
    first = 1 if kind in (b"P1", b"P4") else 2
    width, height = int(found[first]), int(found[first + 1])
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    rest, n = memoryview(data)[found.end() + 1 :], height * width * depth
    kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
    if kind == b"P1":
        plain = re.sub(rb"#[^\n]*|\s", b"", bytes(memoryview(data)[found.end() :]))
        out = np.frombuffer(plain[:n], np.uint8) - 48
        if out.size and out.max() > 1:
            raise ValueError("a Netpbm sample out of range")
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", bytes(rest)).split()[:n], np.int64)
        if out.size and not 0 <= out.min() <= out.max() <= top:
            raise ValueError("a Netpbm sample out of range")
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(rest[: row * height], np.uint8).reshape(height, row), axis=1)
        out = bits[:, :width].reshape(-1)
    else:
        out = np.frombuffer(rest[: n * kind_of.itemsize], kind_of)
    if out.size != n or not n:
        raise ValueError("a Netpbm image that ends early")
    return out.astype(np.uint8 if top < 256 else np.uint16, copy=False).reshape(shape)


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """A grey (P5) or colour (P6) image of 8- or 16-bit samples."""
    height, width = pixels.shape[:2]
    wide = pixels.dtype.itemsize == 2
    head = b"P%d\n%d %d\n%d\n" % (5 + (pixels.ndim == 3), width, height, 65535 if wide else 255)
    return head + pixels.astype(">u2" if wide else np.uint8, copy=False).tobytes()


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask in each value, spread over 0 to 255; 0 without a mask."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return (((values & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 (palette), 16, 24 or 32 bits a pixel as (height, width, 3) in red, green, blue.

    16 bits are five a channel unless masks say where each channel's bits are, as they may for 32 bits too.
    """
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 16, 24, 32) or packed == 3 and bits not in (16, 32) or width <= 0 or height == 0:
        raise ValueError("a BMP form that isn't supported")
    row = -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if bits == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        table = np.zeros((256, 4), np.uint8)
        entries = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)
        table[: len(entries)] = entries
        out = table[raw[:, :width]][:, :, 2::-1]
    elif packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        values = np.ascontiguousarray(raw[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.uint32)
        out = np.stack([_channel(values, m) for m in masks], axis=2)
    else:
        out = raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out if height < 0 else out[::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(height, width, 3) of 8-bit samples as a 24-bit BMP."""
    height, width = pixels.shape[:2]
    row = -(-width * 3 // 4) * 4
    raw = np.zeros((height, row), np.uint8)
    raw[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<IIiiHHIIiiII", 54, 40, width, height, 1, 24, 0, raw.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHH", 54 + raw.size, 0, 0) + head + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2:
        return pixels
    return (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(pixels.dtype)


def _edges(n: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n samples are cut into `out` equal parts, in units of 1 / out of a sample: whole part and rest."""
    return np.divmod(np.arange(out + 1, dtype=np.int64) * n, out)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each of height x width equal areas, edge samples by their part, rounded down; exact in integers.

    The integral image is kept only at the rows where an area begins or ends, a strip of the image at a time.
    """
    rows, columns = pixels.shape
    column, right = _edges(columns, width)

    def across(part: np.ndarray) -> np.ndarray:
        """Row-wise integral at the column edges, in units of 1 / width of a sample."""
        summed = np.zeros((len(part), columns + 1), np.int64)
        np.cumsum(part, axis=1, out=summed[:, 1:])
        beyond = np.concatenate([part, np.zeros((len(part), 1), part.dtype)], axis=1)
        return summed[:, column] * width + beyond[:, column].astype(np.int64) * right

    row, below = _edges(rows, height)
    integral, total, seen = np.zeros((height + 1, width + 1), np.int64), np.zeros(width + 1, np.int64), 0
    for at in range(0, rows, STRIP):
        part = across(pixels[at : at + STRIP])
        down = np.concatenate([np.zeros((1, width + 1), np.int64), np.cumsum(part, axis=0)])
        while seen <= height and row[seen] < at + len(part):
            local = row[seen] - at
            integral[seen] = (total + down[local]) * height + part[local] * below[seen]
            seen += 1
        total = total + down[-1]
    integral[seen:] = total * height
    area = np.diff(np.diff(integral, axis=0), axis=1)
    return (area // (rows * columns)).astype(pixels.dtype)


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: whether each sample of the small picture is less than its right neighbour."""
    small = resize(grey(pixels), *HASH_SHAPE)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(pixels: np.ndarray, shape: tuple[int, int] = TILE_SHAPE) -> bytes:
    """The picture, area-resized to shape, as an NPY file."""
    out = io.BytesIO()
    np.save(out, resize(grey(pixels), *shape), allow_pickle=False)
    return out.getvalue()


def payload_image(payload: bytes) -> bytes:
    """Any bytes, zeros appended to a positive multiple of the width, as a grey Netpbm image of that width."""
    padded = payload.ljust(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH), b"\0")
    return encode_netpbm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 as an image; null is empty, and an empty text one black row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(map(payload_image, texts), pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def describe(media: DataFrame) -> DataFrame:
    """media's other columns and height, width, payload sums, tile (NPY), feature: all from the stored bytes of media.

    Bytes that are no image of a known form, and null, give null in all of these.
    """
    schema = media.drop("media").schema
    added = (
        "height bigint, width bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, tile binary, feature string"
    )
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode(data)
            small, feature = tile(pixels), difference_hash(pixels)
        except (ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error):
            return (None,) * len(kinds)
        samples = memoryview(np.ascontiguousarray(pixels)).cast("B")
        return (
            *pixels.shape[:2], samples.nbytes, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data),
            hashlib.sha256(data).hexdigest(), small, feature,
        )

    def run(batches):
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "media"]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = zip(*map(one, part.column("media").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in rest), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))],
                    names=[*rest, *(x.split()[0] for x in added.split(", "))],
                )

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return media.select(*[F.col(f"`{f.name}`") for f in schema], "media").mapInArrow(run, f"{named}, {added}")
