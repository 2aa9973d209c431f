"""The whole engine over many observations: detect, filter, fuse, redact, gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright import schemas
from veilwright.config import DEFAULT, EngineConfig
from veilwright.operators import context, detect, fusion, gate, ner, redact_image, redact_text
from veilwright.session import importable
from veilwright.sources import images as screens
from veilwright.sources import ocr
from veilwright.stages import Tables


@dataclass
class Inputs:
    """Tables of ``schemas``, keyed by observation_id; absent ones count as empty."""

    observations: DataFrame
    elements: DataFrame | None = None
    regions: DataFrame | None = None
    ocr_words: DataFrame | None = None
    contextual: DataFrame | None = None
    images: DataFrame | None = None


@dataclass
class Result:
    """Every stage as a DataFrame.  Detections, kept detections, entities and redaction are written tables; the rest is lazy."""

    detections: DataFrame
    filtered: DataFrame
    fused: DataFrame
    redaction: DataFrame
    masks: DataFrame
    screens: DataFrame
    verdicts: DataFrame
    trace: DataFrame

    def write(self, folder: str, mode: str = "overwrite") -> None:
        """One Parquet table per stage below ``folder``."""
        for f in fields(self):
            getattr(self, f.name).write.mode(mode).parquet(f"{folder}/{f.name}")


def _or_empty(spark: SparkSession, table: DataFrame | None, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl) if table is None else table


def all_detections(inputs: Inputs, tagger: Callable = ner.dictionary_tagger, config: EngineConfig = DEFAULT) -> DataFrame:
    """The raw detections of all branches, numbered per observation.  Given contextual texts replace tagging of pages and screens."""
    spark = importable(inputs.observations.sparkSession)
    elements = _or_empty(spark, inputs.elements, schemas.ELEMENTS)
    regions = _or_empty(spark, inputs.regions, schemas.REGIONS)
    words = _or_empty(spark, inputs.ocr_words, schemas.OCR_WORDS)
    branches = [detect.detect_elements(elements, config.strict), detect.detect_regions(regions, config.strict), detect.detect_ocr_words(words, config.strict)]
    if inputs.contextual is not None:
        given = inputs.contextual.select("observation_id").distinct()
        regions, words = (t.join(given, "observation_id", "left_anti") for t in (regions, words))
        branches.append(ner.detect_items(inputs.contextual, tagger))
    lines = ocr.word_lines(ocr.quality_filter(words, config).where("status = 'accepted'"), config)
    return detect.union_branches(*branches, ner.detect_dom(regions, tagger), ner.detect_lines(lines, tagger))


def execute(inputs: Inputs, tagger: Callable = ner.dictionary_tagger, config: EngineConfig = DEFAULT) -> Result:
    spark = importable(inputs.observations.sparkSession)
    o = inputs.observations
    regions = _or_empty(spark, inputs.regions, schemas.REGIONS)
    tables = Tables(spark, "engine")  # each stage joins the one before with itself: plans must not nest
    raw = tables.write(all_detections(inputs, tagger, config))
    kept = tables.write(context.context_filter(raw, o))
    filtering = context.filter_trace(raw, kept)
    fused = tables.write(fusion.fuse(kept, o))
    text = tables.write(redact_text.redact_observations(o, regions, fused, config))
    masks = redact_image.mask_rectangles(fused, o, config)
    shown = redact_image.screen_results(masks, o)
    if inputs.images is not None:
        painted = screens.fill_masks(inputs.images, masks.where("status = 'masked'"), config.mask_color)
        shown = shown.join(painted.select("observation_id", "data_url"), "observation_id", "left")
    else:
        shown = shown.withColumn("data_url", F.lit(None).cast("string"))
    n_fused = fused.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n_fused"), F.count_if(F.size("evidence") > 1).alias("merged_groups"))
    rows = o.select("observation_id", "url", "goal", "available_actions", "canvas").join(n_fused, "observation_id", "left").fillna(0, ["n_fused", "merged_groups"])
    rows = rows.join(text.select("observation_id", "sanitized_text", "n_regions", F.col("complete").alias("text_complete"), F.size("unredacted").alias("n_unredacted"), "total_redactions"), "observation_id", "left")
    rows = rows.join(shown.select("observation_id", "success", "data_url", F.col("success").alias("has_canvas"), "visual_complete", F.col("unmasked_count").alias("n_unmasked"), "masked_count"), "observation_id", "left")
    verdicts = gate.gate(rows)
    sources = {"dom": "source = 'DOM'", "dom_text": "source = 'DOM_TEXT'", "ocr": "source = 'OCR'", "tagged_dom": "source = 'RAMPART' and context_source = 'DOM'", "tagged_ocr": "source = 'RAMPART' and context_source = 'OCR'"}
    counts = raw.groupBy("observation_id").agg(*[F.count_if(F.expr(v)).alias(f"n_{k}") for k, v in sources.items()])
    trace = rows.select("observation_id", "n_fused", "merged_groups", "total_redactions", "masked_count").join(counts, "observation_id", "left").join(filtering, "observation_id", "left").join(verdicts.select("observation_id", "allowed"), "observation_id", "left").na.fill(0)
    return Result(raw, kept, fused, text, masks, shown, verdicts, trace)
