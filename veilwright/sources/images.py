"""Screens as raw RGBA: PNG reading and writing, upscaling, statistics, opaque masks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_screens(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder: path, content and Spark's file columns."""
    return spark.read.format("binaryFile").load(path)


def png_encode(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG of (height, width, 4) samples."""
    height, width, _ = rgba.shape
    raw = np.zeros((height, width * 4 + 1), np.uint8)
    raw[:, 1:] = rgba.reshape(height, width * 4)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """(height, width, 4) samples of a non-interlaced 8-bit grey, RGB, grey-alpha or RGBA PNG."""
    if not data or data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        kind = data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported PNG kind")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        line = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, channels)
        out[y] = above = line
        above = above.astype(np.int64)
    flat = out.reshape(height, width, channels)
    alpha = flat[:, :, -1:] if channels in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    colour = flat[:, :, :3] if channels >= 3 else np.repeat(flat[:, :, :1], 3, axis=2)
    return np.concatenate([colour, alpha], axis=2)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.astype(np.uint8)
    if kind == 2:
        return ((line + above) & 255).astype(np.uint8)
    if kind == 1:
        return (np.cumsum(line.reshape(-1, step), axis=0) & 255).ravel().astype(np.uint8)
    done = [0] * len(line)
    for k, value in enumerate(line.tolist()):
        left = done[k - step] if k >= step else 0
        up, corner = int(above[k]), int(above[k - step]) if k >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: (abs(p - v), (left, up, corner).index(v)))
        done[k] = (value + guess) & 255
    return np.array(done, np.uint8)


def upscaled(rgba: np.ndarray, scale: float = 2.0) -> np.ndarray:
    """Nearest-sample scaling; a scale that is not a positive number counts as 2."""
    scale = scale if isinstance(scale, int | float) and scale > 0 else 2.0
    height, width = (max(1, int(np.floor(n * scale + 0.5))) for n in rgba.shape[:2])
    rows = np.minimum((np.arange(height) / scale).astype(int), rgba.shape[0] - 1)
    columns = np.minimum((np.arange(width) / scale).astype(int), rgba.shape[1] - 1)
    return rgba[rows][:, columns]


def upscaled_size(width: Column, height: Column, scale: Column) -> Column:
    k = F.when(scale > 0, scale).otherwise(2.0)
    return F.struct(F.floor(width * k + 0.5).cast("int").alias("width"), F.floor(height * k + 0.5).cast("int").alias("height"))


def upscale_images(images: DataFrame, scale: float = 2.0) -> DataFrame:
    """``images`` (observation_id, width, height, rgba) scaled; rgba is the raw samples."""

    def run(batches):
        for batch in batches:
            done = [upscaled(np.frombuffer(d, np.uint8).reshape(h, w, 4), scale) for w, h, d in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.shape[1] for d in done], pa.int32()), pa.array([d.shape[0] for d in done], pa.int32()), pa.array([d.tobytes() for d in done], pa.binary())], ["observation_id", "width", "height", "rgba"])

    return images.select("observation_id", "width", "height", "rgba").mapInArrow(run, "observation_id string, width int, height int, rgba binary")


def pixel_stats(images: DataFrame) -> DataFrame:
    """observation_id, width, height, has_data, non_zero_percent, non_zero_pixels, total_pixels of raw RGBA rows."""

    def run(batches):
        for batch in batches:
            out = []
            for w, h, d in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if not w or not h or not d:
                    out.append((0, 0, False, 0.0, 0, 0))
                    continue
                p = np.frombuffer(d, np.uint8).reshape(-1, 4)
                n = int(((p[:, 3] > 0) & (p[:, :3] > 0).any(axis=1)).sum())
                out.append((w, h, n > 0, float(np.floor(n / (w * h) * 10000 + 0.5) / 100), n, w * h))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["observation_id", "width", "height", "has_data", "non_zero_percent", "non_zero_pixels", "total_pixels"])

    schema = "observation_id string, width int, height int, has_data boolean, non_zero_percent double, non_zero_pixels long, total_pixels long"
    return images.select("observation_id", "width", "height", "rgba").mapInArrow(run, schema)


def fill_masks(images: DataFrame, masks: DataFrame, colour: tuple[int, int, int, int] = (0, 0, 0, 255)) -> DataFrame:
    """observation_id, png, data_url: every image with its mask rectangles (observation_id, bbox) painted opaque."""
    packed = masks.groupBy("observation_id").agg(F.collect_list("bbox").alias("boxes"))
    joined = images.select("observation_id", "width", "height", "rgba").join(packed, "observation_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for w, h, d, boxes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                p = np.frombuffer(d, np.uint8).reshape(h, w, 4).copy()
                for b in boxes or []:
                    x, y = int(b["x"]), int(b["y"])
                    p[y : y + int(b["height"]), x : x + int(b["width"])] = colour
                out.append(png_encode(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["observation_id", "png"])

    painted = joined.mapInArrow(run, "observation_id string, png binary")
    return painted.withColumn("data_url", F.concat(F.lit("data:image/png;base64,"), F.base64("png")))


def test_card(width: int = 800, height: int = 400) -> np.ndarray:
    """A synthetic screen: a white page with dark bars where lines of text would stand."""
    out = np.full((height, width, 4), 255, np.uint8)
    for k in range(3):
        out[height // 5 * (k + 1) : height // 5 * (k + 1) + 16, width // 20 : width // 2 + 40 * k, :3] = 20
    return out
