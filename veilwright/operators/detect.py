"""Detection branches: form structure, static text, visible text, recognised words.  All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.functions.text import CARD_WORDS, PASSWORD_WORDS, detect_sql
from veilwright.schemas import BOX, DETECTION_COLUMNS

_NULLS = {"context_source": "string", "element_id": "string", "bbox": BOX, "start": "int", "end": "int", "region_index": "int", "ocr_confidence": "double", "text": "string"}


def as_detections(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with all detection columns (absent ones null), keeping the ``order`` columns as a sortable struct ``at``."""
    have = set(rows.columns)
    columns = [F.col(c) if c in have else F.lit(None).cast(_NULLS[c]).alias(c) for c in DETECTION_COLUMNS]
    return rows.select("observation_id", F.struct(*order).alias("at"), *columns)


def secure(rows: DataFrame) -> DataFrame:
    """No text for passwords and structural rows; offsets only in pairs."""
    paired = F.col("start").isNotNull() & F.col("end").isNotNull()
    hidden = (F.col("type") == "PASSWORD") | (F.col("source") == "DOM")
    return rows.withColumns({"text": F.when(~hidden, F.col("text")), "start": F.when(paired, F.col("start")), "end": F.when(paired, F.col("end"))})


def structural_rule() -> Column:
    """struct(type, confidence, reason) of the first rule an element meets, or null: input type, autocomplete, keywords."""
    tag, kind, auto = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("tag", "type", "autocomplete"))
    meta = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "placeholder", "accessible_name")]))

    def rule(name: str, confidence: float, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"), reason.alias("reason"))

    typed = {"password": "PASSWORD", "email": "EMAIL", "tel": "PHONE"}
    said = F.concat(F.lit("autocomplete="), auto)
    out = F.when((tag == "input") & (kind == "password"), rule("PASSWORD", 1.0, F.lit("input[type=password]")))
    for value, name in list(typed.items())[1:]:
        out = out.when((tag == "input") & (kind == value), rule(name, 1.0, F.lit(f"input[type={value}]")))
    out = out.when(F.contains(auto, F.lit("password")), rule("PASSWORD", 1.0, said))
    out = out.when(auto == "email", rule("EMAIL", 1.0, said)).when(F.startswith(auto, F.lit("tel")), rule("PHONE", 1.0, said))
    out = out.when(auto.isin("cc-number", "cc-csc"), rule("CARD", 1.0, said))
    out = out.when(meta.rlike(PASSWORD_WORDS), rule("PASSWORD", 0.95, F.lit("metadata-password-keyword")))
    return out.when(meta.rlike(CARD_WORDS), rule("CARD", 0.95, F.lit("metadata-card-keyword")))


def detect_elements(elements: DataFrame, strict: bool = False) -> DataFrame:
    """Per element: its structural rule, then hits in its text, then new hits in its accessible name."""
    rows = elements.withColumn("rule", structural_rule())
    rows = rows.withColumn("from_text", F.expr(detect_sql("text", strict))).withColumn("from_name", F.expr(detect_sql("accessible_name", strict)))
    twin = "exists({0}, o -> o.type = d.type and o.text = d.text)"
    fresh = F.expr(f"filter(from_name, (d, i) -> not {twin.format('from_text')} and not {twin.format('slice(from_name, 1, i)')})")
    spans = F.concat(F.expr("case when rule is null then array() else array(named_struct('type', rule.type, 'text', cast(null as string), 'confidence', rule.confidence, 'reason', rule.reason, 'start', cast(null as int), 'end', cast(null as int))) end"), F.col("from_text"), fresh)
    hits = rows.select("observation_id", "ord", F.col("element_id"), "bbox", F.posexplode(spans).alias("k", "d"))
    flat = hits.select("observation_id", "ord", "k", "element_id", "bbox", "d.*").withColumn("source", F.when(F.col("start").isNull(), "DOM").otherwise("DOM_TEXT"))
    return as_detections(secure(flat), "ord", "k")


def detect_regions(regions: DataFrame, strict: bool = False) -> DataFrame:
    """Hits in visible text regions, tagged with their region."""
    hits = regions.select("observation_id", "region_index", "element_id", "bbox", F.posexplode(F.expr(detect_sql("text", strict))).alias("k", "d"))
    flat = hits.select("observation_id", "region_index", "element_id", "bbox", "k", "d.*").withColumn("source", F.lit("DOM_TEXT"))
    return as_detections(flat.withColumn("reason", F.concat("reason", F.lit(":reg"), F.col("region_index"))), "region_index", "k")


def detect_ocr_words(words: DataFrame, strict: bool = False) -> DataFrame:
    """Hits in single recognised words, whatever their confidence."""
    hits = words.select("observation_id", "ord", "bbox", F.posexplode(F.expr(detect_sql("text", strict))).alias("k", "d"))
    return as_detections(hits.select("observation_id", "ord", "bbox", "k", "d.*").withColumn("source", F.lit("OCR")), "ord", "k")


def keyword_kind(text: Column) -> Column:
    """Which metadata keyword rule a text meets."""
    return F.when(F.lower(text).rlike(PASSWORD_WORDS), "PASSWORD").when(F.lower(text).rlike(CARD_WORDS), "CARD")


def union_branches(*branches: DataFrame) -> DataFrame:
    """All branches in the order given, numbered per observation; nothing is merged."""
    tagged = [b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)]
    flat = [t.select("observation_id", "branch", *[F.col(f"at.{f.name}").cast("long").alias(f"o{i}") for i, f in enumerate(t.schema["at"].dataType.fields)], *[F.lit(0).cast("long").alias(f"o{i}") for i in range(len(t.schema["at"].dataType.fields), 4)], *DETECTION_COLUMNS) for t in tagged]
    out = flat[0]
    for part in flat[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("observation_id").orderBy("branch", "o0", "o1", "o2", "o3")
    return out.select("observation_id", (F.row_number().over(order) - 1).alias("det_ord"), *DETECTION_COLUMNS)
