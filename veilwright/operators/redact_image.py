"""Mask rectangles for screens, in canvas pixels.  Native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.config import DEFAULT, EngineConfig
from veilwright.functions.geometry import box, scale
from veilwright.schemas import BOX


def mask_rectangles(fused: DataFrame, observations: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """observation_id, fused_ord, type, status, reason, bbox of every entity with a box, on observations with a canvas.

    The box is that of the first recognised evidence (canvas pixels), else the entity's, scaled.
    Status is masked (bbox padded and clamped), offscreen, or unmasked.
    """
    o = observations.where("canvas.width > 0 and canvas.height > 0").select("observation_id", "canvas", scale(F.col("viewport"), F.col("canvas"), F.col("dpr")).alias("by"))
    sized = "{0}.x is not null and {0}.y is not null and {0}.width > 0 and {0}.height > 0"
    seen = F.expr(f"get(filter(evidence, e -> (e.source = 'OCR' or e.context_source = 'OCR') and {sized.format('e.bbox')}), 0).bbox")
    own = F.col("bbox")
    scaled = F.when(F.expr(sized.format("bbox")), F.when(F.col("by").isNotNull(), box(own["x"] * F.col("by.x"), own["y"] * F.col("by.y"), own["width"] * F.col("by.x"), own["height"] * F.col("by.y"))).otherwise(own))
    wanted = F.expr(f"coalesce({sized.format('bbox')}, false) or exists(evidence, e -> coalesce(e.bbox.x is not null and e.bbox.width > 0 and e.bbox.height > 0, false))")
    rows = fused.join(o, "observation_id").where(wanted).withColumn("at", F.coalesce(seen.cast(BOX), scaled.cast(BOX)))
    at, canvas, pad = F.col("at"), F.col("canvas"), config.mask_padding
    x, y = F.greatest(F.lit(0.0), F.floor(at["x"] - pad).cast("double")), F.greatest(F.lit(0.0), F.floor(at["y"] - pad).cast("double"))
    right = F.least(canvas["width"].cast("double"), F.ceil(at["x"] + at["width"] + pad).cast("double"))
    bottom = F.least(canvas["height"].cast("double"), F.ceil(at["y"] + at["height"] + pad).cast("double"))
    inside = (at["x"] < canvas["width"]) & (at["x"] + at["width"] > 0) & (at["y"] < canvas["height"]) & (at["y"] + at["height"] > 0)
    empty = (right - x <= 0) | (bottom - y <= 0)
    status = F.when(at.isNull(), "unmasked").when(~inside, "offscreen").when(empty, "unmasked").otherwise("masked")
    reason = F.when(at.isNull(), "unmappable_visual_coordinates").when(~inside, "outside_screenshot_viewport").when(empty, "zero_or_negative_mask_dimensions")
    shown = F.when(F.col("status") == "masked", box(x, y, right - x, bottom - y)).when(F.col("status") == "offscreen", at)
    return rows.withColumn("status", status).select("observation_id", "fused_ord", "type", "status", reason.alias("reason"), shown.alias("bbox"))


def screen_results(masks: DataFrame, observations: DataFrame) -> DataFrame:
    """observation_id, success, masked_count, offscreen_count, unmasked_count, visual_complete; without a canvas there is no success."""
    n = masks.groupBy("observation_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("masked", "offscreen", "unmasked")])
    present = F.coalesce((F.col("canvas.width") > 0) & (F.col("canvas.height") > 0), F.lit(False))
    out = observations.select("observation_id", present.alias("success")).join(n, "observation_id", "left").fillna(0, ["masked_count", "offscreen_count", "unmasked_count"])
    return out.withColumn("visual_complete", F.col("success") & (F.col("unmasked_count") == 0))
