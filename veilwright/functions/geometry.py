"""Boxes (struct of x, y, width, height) as native expressions.  A null box has no geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.schemas import BOX


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def overlap_lengths(a: Column, b: Column) -> tuple[Column, Column]:
    """Signed overlap on both axes; negative is a gap.  Both boxes must be there: ``least`` and ``greatest`` skip nulls."""
    return tuple(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]) for p, s in (("x", "width"), ("y", "height")))


def overlap_area(a: Column, b: Column) -> Column:
    w, h = overlap_lengths(a, b)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where a box is missing."""
    inter = overlap_area(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(a.isNull() | b.isNull() | (inter <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def centre_distance(a: Column, b: Column) -> Column:
    """Distance of centres; infinite where a box is missing."""
    dx = a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2
    dy = a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2
    return F.when(a.isNull() | b.isNull(), float("inf")).otherwise(F.hypot(dx, dy))


def contained(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether the overlap is more than ``share`` of the smaller box; false where one is missing."""
    least = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.coalesce(a.isNotNull() & b.isNotNull() & (least > 0) & (overlap_area(a, b) > share * least), F.lit(False))


def boxes_touch(a: Column, b: Column, tolerance: float = 8) -> Column:
    """Whether boxes intersect or come within ``tolerance`` on both axes; false where one is missing."""
    w, h = overlap_lengths(a, b)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (w >= -tolerance) & (h >= -tolerance), F.lit(False))


def union_sql(boxes: str) -> str:
    """SQL for the box around an array of boxes, skipping incomplete ones; null if none is left."""
    good = f"filter({boxes}, b -> b.x is not null and b.y is not null and b.width is not null and b.height is not null)"
    x, y = (f"array_min(transform(s, b -> b.{k}))" for k in "xy")
    right, bottom = (f"array_max(transform(s, b -> b.{p} + b.{s}))" for p, s in (("x", "width"), ("y", "height")))
    return f"transform(array({good}), s -> case when size(s) > 0 then cast(named_struct('x', {x}, 'y', {y}, 'width', {right} - {x}, 'height', {bottom} - {y}) as {BOX}) end)[0]"


def scale(viewport: Column, canvas: Column, dpr: Column) -> Column:
    """Canvas pixels per viewport pixel (x, y): by sizes, else by device pixel ratio; null where neither is known."""
    ratio = F.coalesce(F.when(viewport["dpr"] > 0, viewport["dpr"]), F.when(dpr > 0, dpr))
    height = F.when(viewport["height"] != 0, viewport["height"]).otherwise(viewport["width"])
    sized = (canvas["width"] > 0) & (viewport["width"] > 0)
    by_size = F.struct((canvas["width"] / viewport["width"]).cast("double").alias("x"), (canvas["height"] / F.coalesce(height, viewport["width"])).cast("double").alias("y"))
    return F.when(sized, by_size).when(ratio.isNotNull(), F.struct(ratio.cast("double").alias("x"), ratio.cast("double").alias("y")))


def target_scale(viewport: Column, canvas: Column, dpr: Column) -> Column:
    """As ``scale``, for a canvas that is always there: only the viewport decides."""
    return scale(viewport, canvas, dpr)


def normalize_box(b: Column, source: Column, context: Column, by: Column) -> Column:
    """The box in viewport pixels: boxes from the canvas are divided by its scale; null without a position."""
    ocr = F.coalesce(source == "OCR", F.lit(False)) | F.coalesce(context == "OCR", F.lit(False))
    width, height = (F.coalesce(b[k], F.lit(0.0)) for k in ("width", "height"))
    plain = box(b["x"], b["y"], width, height)
    scaled = box(b["x"] / by["x"], b["y"] / by["y"], width / by["x"], height / by["y"])
    known = b.isNotNull() & b["x"].isNotNull() & b["y"].isNotNull()
    return F.when(known & ocr & (by["x"] > 0) & (by["y"] > 0), scaled).when(known, plain)
