"""Media columns: Netpbm and BMP bytes to arrays, area resizing by integral images, NPY tiles, difference hashes.

``media_features`` keeps any bytes as the samples of a greyscale image WIDTH wide, writes it as PGM, reads
the stored bytes back through the same decoder that outside images go through, and computes the features from what it read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

UNIT = 576
WIDTH = 24
TILE = 16
_ROWS = 1 << 14


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, padded to four bytes."""
    rgb = samples if samples.ndim == 3 else np.repeat(samples[:, :, None], 3, axis=2)
    h, w = rgb.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic number, and where the single white space after them ends; comments run from # to the line's end."""
    got, at = [], 2
    while len(got) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        got.append(int(data[at:end]))
        at = end
    return got, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    (w, h, *most), at = _header(data, 2 if kind in (1, 4) else 3)
    depth, most = (3 if kind in (3, 6) else 1), (most or [1])[0]
    if not 0 < most < 65536:
        raise ValueError("the largest value is out of range")
    n = w * h * depth
    if kind == 4:
        bits = np.frombuffer(data, np.uint8, -(-w // 8) * h, at).reshape(h, -1)
        return (1 - np.unpackbits(bits, axis=1)[:, :w]) * np.uint8(255)
    if kind == 1:
        cells = np.array([c - 48 for c in data[at - 1 :] if c in b"01"][:n], np.uint8)
        return (1 - cells.reshape(h, w)) * np.uint8(255)
    if kind in (2, 3):
        values = np.array(data[at:].split()[:n], np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    values = values.astype(np.uint8, copy=False)
    return values.reshape((h, w, 3) if depth == 3 else (h, w))


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The samples that a mask of adjoining bits picks, at 8 bits."""
    shift = (mask & -mask).bit_length() - 1
    most = mask >> max(shift, 0)
    if not mask or most & (most + 1):
        raise ValueError("the bits of a colour do not adjoin")
    return (((pixels & mask) >> shift) * 255 + most // 2) // most


def _bmp(data: bytes) -> np.ndarray:
    """8 bits with a palette, 24 or 32 bits as blue, green, red, and 32 bits with a mask for each colour; a fourth channel is left out."""
    start, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if (packed, bits) not in ((0, 8), (0, 24), (0, 32), (3, 32)) or w <= 0 or size < 40:
        raise ValueError("this kind of BMP is not supported")
    step = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<46xI", data)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[rows]
    if packed == 3:
        pixels = np.ascontiguousarray(rows).view("<u4").astype(np.int64)
        return np.stack([_channel(pixels, m) for m in struct.unpack_from("<54xIII", data)], axis=2).astype(np.uint8)
    return np.ascontiguousarray(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes | None) -> np.ndarray | None:
    """uint8 samples (h, w) or (h, w, 3) of a Netpbm (P1 to P6) or BMP image; None for what is not a whole one."""
    try:
        if data and len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(bytes(data))
        if data and data[:2] == b"BM":
            return _bmp(bytes(data))
    except (ValueError, struct.error, IndexError, MemoryError):
        return None
    return None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else ((image.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=2) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of the new pixels, from the integral image.

    The integral is needed at the new pixels' edges only: it is linear between whole places, and its rows are summed up
    block by block, so a very tall image takes little memory.
    """
    h, w = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    y0 = np.minimum(ys.astype(np.int64), h - 1)
    at = np.zeros((height + 1, width + 1))
    above = np.zeros(w)
    for lo in range(0, h, _ROWS):
        block = image[lo : lo + _ROWS].astype(np.float64)
        rows = np.vstack([above, above + np.cumsum(block, axis=0)])  # row i: sum of the rows before lo + i
        here = np.flatnonzero((y0 >= lo) & (y0 < lo + len(block)))
        part = rows[y0[here] - lo] + (ys - y0)[here, None] * block[y0[here] - lo]
        across = np.hstack([np.zeros((len(here), 1)), np.cumsum(part, axis=1)])
        at[here] = across[:, x0] + (xs - x0) * part[:, x0]
        above = rows[-1]
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((ys[1:] - ys[:-1])[:, None] * (xs[1:] - xs[:-1]))


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image at side x side as the bytes of an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(area_resize(image, side, side)).astype(np.uint8), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: each of 8 x 9 means against its right neighbour."""
    small = np.rint(area_resize(image, 8, 9) * 256).astype(np.int64)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def payload_image(raw: bytes) -> np.ndarray:
    """Bytes, with 255 up to a positive multiple of UNIT, as rows of WIDTH samples."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)


def _features(with_bytes):
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = t.as_py() or b""
                stored = encode_pgm(payload_image(raw))
                image = decode(stored)
                back = image.tobytes()
                tile = npy_tile(image)
                feature = f"{difference_hash(image)}:{image.shape[1]}x{image.shape[0]}:{zlib.crc32(tile):08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored if with_bytes else None, tile if with_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "tile"]
            n = len(names) if with_bytes else len(names) - 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in list(zip(list(zip(*rows)) or [()] * 9, kinds))[:n])], ["doc_id", *names[:n]])

    return run


def media_features(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """A row for every row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with_bytes also media and tile (NPY).

    A null or empty value is one unit of bytes 255. Equal values give equal columns, so repeated rows do. Null ids stay null. Very long values are stored and read
    back whole, one at a time. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).cast("binary").alias("data"))
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_features(with_bytes), kinds + ", media binary, tile binary" * with_bytes)


def _tiles(side):
    def run(batches):
        for b in batches:
            images = [decode(x.as_py()) for x in b.column(1)]
            good = [x is not None and x.size > 0 for x in images]
            flat = [grey(x) if ok else None for x, ok in zip(images, good)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x.shape[1] if ok else None for x, ok in zip(images, good)], pa.int32()),
                    pa.array([x.shape[0] if ok else None for x, ok in zip(images, good)], pa.int32()),
                    pa.array([npy_tile(x, side) if ok else None for x, ok in zip(flat, good)], pa.binary()),
                    pa.array([difference_hash(x) if ok else None for x, ok in zip(flat, good)], pa.string()),
                ],
                ["id", "width", "height", "tile", "dhash"],
            )

    return run


def image_tiles(images: DataFrame, id_col: str, data_col: str, side: int = TILE) -> DataFrame:
    """(id, width, height, tile, dhash) of Netpbm or BMP bytes; nulls beside the id where the bytes are null or not a whole image. An empty table stays empty."""
    rows = images.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).cast("binary").alias("data"))
    return rows.mapInArrow(_tiles(side), "id string, width int, height int, tile binary, dhash string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
