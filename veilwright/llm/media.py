"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled, and hashed.

All work is row-local (one Arrow pass, no shuffle); a batch is bounded by Spark's Arrow batch
bytes and each image is handled alone.
"""

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

from veilwright.llm.common import id_and_text, parts

UNIT = 192
WIDTH = 64
TILE = 16
BAND = 4096

_SPACE = rb"(?:[ \t\r\n\x0b\x0c]|#[^\n\r]*[\n\r])+"


class MediaError(ValueError):
    """The bytes are not an image of a supported kind."""


def encode_ppm(samples: np.ndarray) -> bytes:
    """A binary Netpbm file (P5 for two axes, P6 for three) of 8-bit samples."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of (height, width, 3) RGB samples."""
    height, width, _ = samples.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6, up to 8 bits) or uncompressed BMP (8, 24, 32 bits) file, as uint8."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if re.match(rb"P[1-6][ \t\r\n#]", data[:3]):
        return _decode_netpbm(data)
    raise MediaError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - ord("0")
    bitmap, plain = kind in (1, 4), kind < 4
    numbers = 2 if bitmap else 3
    head = re.match(rb"P\d" + (_SPACE + rb"(\d+)") * numbers + rb"[ \t\r\n]", data)
    if not head:
        raise MediaError("damaged Netpbm header")
    width, height, *rest = map(int, head.groups())
    most = rest[0] if rest else 1
    if not 0 < most < 256:
        raise MediaError("only 8-bit samples are supported")
    channels = 3 if kind in (3, 6) else 1
    body = data[head.end() :]
    need = width * height * channels
    if kind == 4:
        stride = (width + 7) // 8
        bits = np.frombuffer(body[: stride * height], np.uint8)
        if bits.size < stride * height:
            raise MediaError("truncated image")
        flat = (1 - np.unpackbits(bits.reshape(height, stride), axis=1)[:, :width].ravel()) * np.uint8(255)
    elif plain:
        body = re.sub(rb"#[^\n\r]*", b"", body)
        values = list(re.sub(rb"\s+", b"", body)) if bitmap else [int(x) for x in body.split()]
        flat = np.array(values[:need], np.int64)
        flat = (1 - (flat - ord("0"))) * 255 if bitmap else flat
        flat = flat.astype(np.uint8)
    else:
        flat = np.frombuffer(body[:need], np.uint8)
    if flat.size < need:
        raise MediaError("truncated image")
    if not bitmap and most != 255:
        flat = ((flat.astype(np.uint32) * 255 + most // 2) // most).astype(np.uint8)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("truncated image")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing != 0 or depth not in (8, 24, 32) or width <= 0 or not height:
        raise MediaError("only uncompressed 8, 24 and 32 bit BMP files are supported")
    stride = (width * depth // 8 + 3) // 4 * 4
    flat = np.frombuffer(data[offset : offset + stride * abs(height)], np.uint8)
    if flat.size < stride * abs(height):
        raise MediaError("truncated image")
    rows = flat.reshape(abs(height), stride)[:: 1 if height < 0 else -1]
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data[14 + size : 14 + size + 4 * colours], np.uint8).reshape(-1, 4)
        return palette[rows[:, :width]][:, :, 2::-1]
    step = depth // 8
    return rows[:, : width * step].reshape(abs(height), width, step)[:, :, 2::-1]


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the exact mean over its (fractional) source area, from an integral image; float64.

    The integral image is made in bands of ``BAND`` rows, each carrying on the sums above it, and read
    where a target edge falls; so a tall image takes memory for one band beside its samples.
    """
    rows, columns = samples.shape[:2]
    edges = np.linspace(0, rows, height + 1)
    table = np.zeros((height + 1, width + 1) + samples.shape[2:])
    above = np.zeros((1, columns + 1) + samples.shape[2:])
    for a in range(0, rows, BAND):
        b = min(rows, a + BAND)
        band = np.zeros((b - a + 1, columns + 1) + samples.shape[2:])
        np.cumsum(np.cumsum(samples[a:b].astype(np.float64), axis=0), axis=1, out=band[1:, 1:])
        band += above
        here = (edges >= a) & ((edges < b) | (b == rows))
        table[here] = _edges(_edges(band, edges[here] - a, 0), np.linspace(0, columns, width + 1), 1)
        above = band[-1:]
    sums = table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]
    return sums * (height * width) / (rows * columns)


def _edges(table: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    low = np.minimum(at.astype(np.int64), table.shape[axis] - 1)
    high = np.minimum(low + 1, table.shape[axis] - 1)
    part = (at - low).reshape((-1,) + (1,) * (table.ndim - axis - 1))
    return np.take(table, low, axis) * (1 - part) + np.take(table, high, axis) * part


def grey(samples: np.ndarray) -> np.ndarray:
    """Luma of RGB samples in float32; grey samples as they are."""
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114], np.float32)


def difference_hash(samples: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 area-resized grey image is darker than its right neighbour."""
    small = np.round(area_resize(grey(samples), 8, 9), 6)
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy_tile(samples: np.ndarray, side: int = TILE) -> bytes:
    """The image area-resized to ``side`` x ``side`` grey samples, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(samples), side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes padded with spaces to a positive multiple of ``UNIT``; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def store(payload: bytes) -> bytes:
    """One row of 64 RGB pixels for each unit: a P6 file for an odd number of rows, a BMP for an even one."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return encode_ppm(samples) if len(samples) % 2 else encode_bmp(samples)


MEDIA_SCHEMA = "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the text stored as a P6 or BMP image, read back, with its tile and difference hash.

    Null text counts as empty (one unit of spaces).  Equal texts give equal values; a null id is
    carried.  An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)

    def converted(batches):
        for batch in parts(batches):
            out = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                raw = len((text or "").encode("utf-8", "replace"))
                media = store(payload_of(text))
                samples = decode(media)
                back, tile = samples.tobytes(), npy_tile(samples)
                feature = f"{difference_hash(samples):016x}:{zlib.crc32(tile):08x}"
                values = (raw, media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), tile, feature)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
            names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", *names])

    return rows.mapInArrow(converted, f"doc_id {rows.schema[0].dataType.simpleString()}, {MEDIA_SCHEMA}")


def image_tiles(files: DataFrame, id_col: str = "path", content_col: str = "content", side: int = TILE) -> DataFrame:
    """id, height, width, channels, tile (NPY), dhash and error for rows of image bytes (such as ``binaryFile``).

    Null or undecodable bytes give null values and a text in ``error``.
    """
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{content_col}`").alias("content"))

    def decoded(batches):
        for batch in parts(batches):
            out = [[] for _ in range(6)]
            for data in batch.column(1).to_pylist():
                try:
                    samples = decode(data or b"")
                    values = (*samples.shape[:2], 1 if samples.ndim == 2 else 3, npy_tile(samples, side), f"{difference_hash(samples):016x}", None)
                except (MediaError, ValueError, struct.error) as e:
                    values = (None, None, None, None, None, str(e))
                for column, value in zip(out, values):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], ["id", "height", "width", "channels", "tile", "dhash", "error"])

    return rows.mapInArrow(decoded, f"id {rows.schema[0].dataType.simpleString()}, height int, width int, channels int, tile binary, dhash string, error string")
