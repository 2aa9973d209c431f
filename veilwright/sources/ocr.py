"""Recognised words: normalising, quality filter, and reading lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.config import DEFAULT, EngineConfig
from veilwright.functions.text import rescale_confidence, round_half_up, trim
from veilwright.schemas import OCR_LINES, WORD


def normalize_words(raw: DataFrame) -> DataFrame:
    """``raw``: observation_id, ord, text, confidence, x0, y0, x1, y1 → observation_id, ord, text, confidence, bbox.

    Blank words go; percentages become fractions of two decimals; edges are rounded.
    """
    text = trim(F.coalesce(F.col("text"), F.lit("")))
    box = F.struct(
        round_half_up(F.col("x0")).alias("x"),
        round_half_up(F.col("y0")).alias("y"),
        round_half_up(F.col("x1") - F.col("x0")).alias("width"),
        round_half_up(F.col("y1") - F.col("y0")).alias("height"),
    )
    kept = raw.withColumn("text", text).where("text <> ''")
    return kept.select("observation_id", "ord", "text", round_half_up(rescale_confidence(F.col("confidence")), 2).alias("confidence"), box.alias("bbox"))


def recognise(images: DataFrame, recogniser: Callable[[bytes], list[tuple]], key: str = "path", content: str = "content") -> DataFrame:
    """Words of images by a recogniser that gives (text, confidence, x0, y0, x1, y1) rows; a failing image gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = recogniser(data) if data else []
                except Exception:  # one bad image must not fail the batch
                    found = []
                rows += [(i, k, *map_row) for k, map_row in enumerate(found)]
            kinds = [pa.string(), pa.int32(), pa.string()] + [pa.float64()] * 5
            names = ["observation_id", "ord", "text", "confidence", "x0", "y0", "x1", "y1"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    raw = images.select(F.col(key).cast("string"), F.col(content)).mapInArrow(run, "observation_id string, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    return normalize_words(raw)


def quality_status(text: Column, box: Column, confidence: Column, config: EngineConfig = DEFAULT) -> Column:
    """accepted, or the first reason against: empty_text, invalid_bbox, low_confidence."""
    limit = config.min_confidence / 100 if config.min_confidence > 1 else config.min_confidence
    whole = F.coalesce(box["x"].isNotNull() & box["y"].isNotNull() & (box["width"] > 0) & (box["height"] > 0), F.lit(False))
    blank = F.coalesce(trim(text) == "", F.lit(True))
    return F.when(blank, "empty_text").when(~whole, "invalid_bbox").when(rescale_confidence(confidence) < limit, "low_confidence").otherwise("accepted")


def quality_filter(words: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``words`` with their ``status``."""
    return words.withColumn("status", quality_status(F.col("text"), F.col("bbox"), F.col("confidence"), config))


def quality_stats(words: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    by = quality_filter(words, config).groupBy("observation_id")
    limit = config.min_confidence / 100 if config.min_confidence > 1 else config.min_confidence
    return by.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") != "accepted").alias("rejected")).withColumn("threshold", F.lit(limit))


# -------------------------------------------------------------------------------- reading lines

#: Lines are handed on once they hold so many words; as Python objects a word takes about 1 kB.
HELD_WORDS = 1 << 13


class _Row:
    """Words at about one height: their hull and mean height grow as words join."""

    def __init__(self, word: dict):
        b = word["bbox"]
        self.left, self.top, self.right, self.bottom = b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]
        self.words, self.heights = [word], max(1.0, b["height"])

    def mean_height(self) -> float:
        return self.heights / len(self.words)

    def distance(self, middle: float) -> float:
        return abs(middle - (self.top + self.bottom) / 2)

    def accepts(self, top: float, height: float, ratio: float) -> bool:
        near = self.distance(top + height / 2) <= self.mean_height() * ratio
        return near or min(top + height, self.bottom) > max(top, self.top)

    def add(self, word: dict, height: float) -> None:
        b = word["bbox"]
        self.words.append(word)
        self.heights += height
        self.left, self.top = min(self.left, b["x"]), min(self.top, b["y"])
        self.right, self.bottom = max(self.right, b["x"] + b["width"]), max(self.bottom, b["y"] + height)


def _reading_order(rows: list, slack: float, box=lambda r: r["bbox"]) -> list:
    """Top to bottom, left to right among rows of about one height."""

    def compare(a, b):
        down = box(a)["y"] - box(b)["y"]
        across = box(a)["x"] - box(b)["x"]
        value = down if abs(down) > slack else across
        return (value > 0) - (value < 0)

    return sorted(rows, key=cmp_to_key(compare))


def _line(words: list[dict]) -> dict:
    boxes = [w["bbox"] for w in words]
    x, y = min(b["x"] for b in boxes), min(b["y"] for b in boxes)
    right, bottom = max(b["x"] + b["width"] for b in boxes), max(b["y"] + b["height"] for b in boxes)
    return {"text": " ".join(w["text"] for w in words), "bbox": {"x": x, "y": y, "width": right - x, "height": bottom - y}, "words": words}


def _complete(word: dict | None) -> bool:
    box = (word or {}).get("bbox")
    return bool(box) and bool((word.get("text") or "").strip()) and all(box[k] is not None for k in ("x", "y", "width", "height"))


def build_lines(words: list[dict], config: EngineConfig = DEFAULT) -> list[dict]:
    """Reading lines of one image: words join the nearest row at their height, rows break at wide gaps."""
    rows: list[_Row] = []
    for word in _reading_order([w for w in words if _complete(w)], 4):
        top, height = word["bbox"]["y"], max(1.0, word["bbox"]["height"])
        fitting = [r for r in rows if r.accepts(top, height, config.y_tolerance_ratio)]
        if fitting:
            min(fitting, key=lambda r: r.distance(top + height / 2)).add(word, height)
        else:
            rows.append(_Row(word))
    lines: list[dict] = []
    for row in rows:
        widest = row.mean_height() * config.max_gap_ratio
        ordered = sorted(row.words, key=lambda w: w["bbox"]["x"])
        part = ordered[:1]
        for before, word in zip(ordered, ordered[1:]):
            if word["bbox"]["x"] - (before["bbox"]["x"] + before["bbox"]["width"]) > widest:
                lines.append(_line(part))
                part = []
            part.append(word)
        lines.append(_line(part))
    return _reading_order(lines, 6)


def simple_lines(words: list[dict]) -> list[dict]:
    """The plainer grouping: a word joins the first line within half the larger height; gaps do not break lines."""
    lines: list[dict] = []
    for word in _reading_order([w for w in words if w and w.get("text") and w.get("bbox") and w["bbox"]["y"] is not None], 6):
        b = word["bbox"]
        height = b["height"] or 16
        middle = b["y"] + height / 2
        for line in lines:
            o = line["bbox"]
            if abs(middle - o["y"] - o["height"] / 2) <= max(height, o["height"] or 16) / 2:
                hull = {"x": min(o["x"], b["x"]), "y": min(o["y"], b["y"])}
                # the right and bottom edges are taken after the corner has moved
                hull["width"] = max(hull["x"] + o["width"], b["x"] + b["width"]) - hull["x"]
                hull["height"] = max(hull["y"] + o["height"], b["y"] + b["height"]) - hull["y"]
                line["bbox"] = hull
                line["words"].append(word)
                break
        else:
            lines.append({"bbox": dict(b), "words": [word]})
    for line in lines:
        line["words"].sort(key=lambda w: w["bbox"]["x"])
        line["text"] = " ".join(w["text"] for w in line["words"])
    return lines


def _by_observation(batches):
    """(observation, its words) of batches whose rows are sorted by observation; only one observation is held at a time."""
    key, words = None, []
    for batch in batches:
        for observation, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words and observation != key:
                yield key, words
                words = []
            key = observation
            words.append(word)
    if words:
        yield key, words


def word_lines(words: DataFrame, config: EngineConfig = DEFAULT, builder: Callable = build_lines) -> DataFrame:
    """observation_id, line_ord, text, bbox, words of word rows; one row-local call an observation.

    Words reach the workers as sorted rows, not packed by observation: a batch of packed rows has no bound in words.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    word = F.struct("text", "bbox", F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    dealt = words.select("observation_id", "ord", word.cast(WORD).alias("word")).repartition("observation_id").sortWithinPartitions("observation_id", "ord", "word")
    fields = words.sparkSession.createDataFrame([], OCR_LINES).schema.fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    def run(batches):
        rows, held = [], 0
        for observation, own in _by_observation(batches):
            built = builder(own) if builder is simple_lines else builder(own, config)
            rows += [(observation, k, line["text"], line["bbox"], line["words"]) for k, line in enumerate(built)]
            held += len(own)
            if held >= HELD_WORDS and rows:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    return dealt.select("observation_id", "word").mapInArrow(run, OCR_LINES)
