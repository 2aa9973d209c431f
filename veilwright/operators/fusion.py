"""Fusion: detections of one observation that match become one canonical entity.

Candidate pairs come from equi-joins on (observation, type) and, where the rule allows, on
element or normalised text too, so only structural and fuzzy candidates meet by type alone.
Links are few; a row-local call per observation with links joins them in their fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.config import NEVER_FUZZY
from veilwright.functions.geometry import centre_distance, contained, iou, normalize_box
from veilwright.functions.text import normalize_text, similar_texts, source_key, source_priority, text_quality, trim
from veilwright.operators.context import with_scale
from veilwright.operators.graph import Forest, per_observation
from veilwright.schemas import DETECTION_COLUMNS


def prepared(detections: DataFrame, observations: DataFrame) -> DataFrame:
    """Detections with norm_text, norm_box, structural, key, priority and quality."""
    d = with_scale(detections, observations)
    c = F.col
    return d.withColumns(
        {
            "norm_text": normalize_text(c("text"), c("type")),
            "norm_box": normalize_box(c("bbox"), c("source"), c("context_source"), c("by")),
            "structural": F.coalesce((c("source") == "DOM") & c("text").isNull(), F.lit(False)),
            "key": source_key(c("source"), c("context_source")),
            "priority": source_priority(c("source"), c("context_source")),
            "quality": text_quality(c("text"), c("type"), c("source"), c("context_source"), c("confidence"), c("ocr_confidence")),
        }
    ).drop("by")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = ("source", "element_id", "structural", "norm_text", "norm_box")
    return tuple(rows.select("observation_id", "type", F.col("det_ord").alias(n), *[F.col(f).alias(f"{n}_{f}") for f in fields]) for n in ("i", "j"))


def _same_element() -> Column:
    return F.coalesce((F.col("i_element_id") == F.col("j_element_id")) & (F.col("i_element_id") != ""), F.lit(False))


def structural_match(a: Column, b: Column) -> Column:
    return (iou(a, b) > 0.2) | contained(a, b)


def equal_text_match(same_source: Column, a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    near, far = (iou(a, b) > 0.3) | (centre_distance(a, b) < 35), (iou(a, b) > 0) | (centre_distance(a, b) < 200)
    return F.when(same_source, both & near).otherwise(~both | far)


def fuzzy_match(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & ((iou(a, b) > 0.2) | (centre_distance(a, b) < 80))


def match_links(rows: DataFrame) -> DataFrame:
    """(observation_id, i, j, kind) with i < j and kind EXACT or FUZZY."""
    rows = rows.where("type is not null")
    left, right = _sides(rows)
    boxes = F.col("i_norm_box"), F.col("j_norm_box")
    ordered = F.col("i") < F.col("j")

    def links(pairs: DataFrame, where: Column, kind: str) -> DataFrame:
        return pairs.where(ordered & where).select("observation_id", "i", "j", F.lit(kind).alias("kind"))

    on_element = left.withColumn("e", F.col("i_element_id")).join(right.withColumn("e", F.col("j_element_id")), ["observation_id", "type", "e"])
    same = links(on_element, _same_element(), "EXACT")

    structural = left.where("i_structural").join(right, ["observation_id", "type"])
    mirrored = left.where("not i_structural").join(right.where("j_structural"), ["observation_id", "type"])
    by_box = links(structural.unionByName(mirrored), ~_same_element() & structural_match(*boxes), "EXACT")

    texts_i, texts_j = left.where("not i_structural and i_norm_text <> ''"), right.where("not j_structural and j_norm_text <> ''")
    on_text = texts_i.withColumn("t", F.col("i_norm_text")).join(texts_j.withColumn("t", F.col("j_norm_text")), ["observation_id", "type", "t"])
    equal = links(on_text, ~_same_element() & equal_text_match(F.coalesce(F.col("i_source") == F.col("j_source"), F.lit(False)), *boxes), "EXACT")

    loose = ~F.col("type").isin(*NEVER_FUZZY)
    near = texts_i.where(loose & F.col("i_norm_box").isNotNull()).join(texts_j.where(loose & F.col("j_norm_box").isNotNull()), ["observation_id", "type"])
    differ = (F.col("i_norm_text") != F.col("j_norm_text")) & ~_same_element() & fuzzy_match(*boxes)
    fuzzy = links(near.where(ordered & differ), similar_texts(F.col("i_norm_text"), F.col("j_norm_text"), F.col("type")), "FUZZY")
    return same.unionByName(by_box).unionByName(equal).unionByName(fuzzy)


def clusters(rows: DataFrame) -> DataFrame:
    """``rows`` (prepared) with ``root``, the smallest det_ord of their entity."""
    item = rows.select("observation_id", F.col("det_ord").alias("k"), F.struct("norm_text", "norm_box").alias("item"))
    links = match_links(rows)
    for end in ("i", "j"):
        side = item.select("observation_id", F.col("k").alias(end), F.col("item").alias(f"item_{end}"))
        links = links.join(side, ["observation_id", end])
    roots = per_observation(links, join_links).withColumnRenamed("value", "root")
    return rows.join(roots, ["observation_id", "det_ord"], "left").withColumn("root", F.coalesce("root", "det_ord"))


def join_links(links: list[dict]) -> list[tuple[int, int]]:
    """Exact links join at once; fuzzy links in order, if every pair across both sets is consistent."""
    sets = Forest()
    items: dict[int, dict] = {}
    members: dict[int, list[int]] = {}
    for link in links:
        items[link["i"]], items[link["j"]] = link["item_i"], link["item_j"]
        if link["kind"] == "EXACT":
            sets.join(link["i"], link["j"])
    for k in items:
        members.setdefault(sets.root(k), []).append(k)
    for link in links:
        a, b = sets.root(link["i"]), sets.root(link["j"])
        if link["kind"] == "FUZZY" and a != b and all(consistent(items[x], items[y]) for x in members[a] for y in members[b]):
            sets.join(a, b)
            root = sets.root(a)
            members[root] = members.pop(a) + members.pop(b)
    return [(k, sets.root(k)) for k in items]


def consistent(a: dict, b: dict) -> bool:
    """Texts not too different, boxes not apart."""
    x, y = a["norm_text"], b["norm_text"]
    if x and y and x != y and 1 - edit_distance(x, y) / max(len(x), len(y)) < 0.75:
        return False
    p, q = a["norm_box"], b["norm_box"]
    if p and q:
        w = min(p["x"] + p["width"], q["x"] + q["width"]) - max(p["x"], q["x"])
        h = min(p["y"] + p["height"], q["y"] + q["height"]) - max(p["y"], q["y"])
        dx = p["x"] + p["width"] / 2 - q["x"] - q["width"] / 2
        dy = p["y"] + p["height"] / 2 - q["y"] - q["height"] / 2
        if not (w > 0 and h > 0) and (dx * dx + dy * dy) ** 0.5 > 100:
            return False
    return True


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


# ------------------------------------------------------------------------------- canonical entities

_C = "coalesce(m.confidence, 0.5D)"


def fused_confidence_sql(members: str) -> str:
    """SQL: the best confidence, raised by 15 % of the headroom times the best of each other source key in order of appearance."""
    best = f"array_max(transform({members}, m -> {_C}))"
    lead = f"get(filter({members}, m -> {_C} = {best}), 0).key"
    others = f"array_distinct(transform(filter({members}, m -> m.key <> {lead}), m -> m.key))"
    fold = f"aggregate({others}, {best}, (c, k) -> c + (1 - c) * (0.15D * array_max(transform(filter({members}, m -> m.key = k), m -> {_C}))))"
    return f"least(1D, floor({fold} * 1000 + 0.5D) / 1000)"


def canonical(rows: DataFrame) -> DataFrame:
    """One row per entity of clustered rows (with ``root``), numbered by first member: fields, sources, evidence."""
    fields = ["det_ord", *DETECTION_COLUMNS, "norm_box", "key", "priority", "quality"]
    packed = rows.groupBy("observation_id", "root").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("mm"))
    ranked = "transform(array_sort(transform(mm, x -> named_struct('p', -x.priority, 'c', -coalesce(x.confidence, 0D), 'o', x.det_ord, 'x', x))), r -> r.x)"
    p = packed.withColumn("n", F.size("mm")).withColumn("r", F.expr(ranked)).withColumn("one", F.expr("mm[0]"))
    best_text = "array_max(transform(filter(mm, x -> x.quality is not null), x -> named_struct('q', x.quality, 'o', -x.det_ord, 't', x.text))).t"
    first = "get(filter(r, x -> x.{0} is not null and x.{0} <> ''), 0).{0}"
    evidence = "transform(mm, x -> named_struct('source', x.source, 'confidence', x.confidence, 'text', x.text, 'bbox', x.bbox, 'element_id', x.element_id, 'reason', x.reason, 'context_source', x.context_source, 'ocr_confidence', x.ocr_confidence, 'start', x.start, 'end', x.end))"
    many = {
        "type": "r[0].type",
        "source": "'FUSED'",
        "context_source": f"coalesce(nullif(r[0].context_source, ''), {first.format('context_source')})",
        "element_id": first.format("element_id"),
        "confidence": fused_confidence_sql("mm"),
        "reason": "r[0].reason",
        "bbox": "transform(array(get(filter(r, x -> x.bbox.x is not null), 0)), x -> coalesce(x.norm_box, x.bbox))[0]",
        "start": "cast(null as int)",
        "end": "cast(null as int)",
        "region_index": "cast(null as int)",
        "ocr_confidence": "array_max(transform(mm, x -> x.ocr_confidence))",
    }
    chosen = [F.expr(f"case when n = 1 then one.{k} else {v} end").alias(k) for k, v in many.items() if k != "region_index"]
    # an entity of one row keeps its box as it was found, and no region
    text = F.when(F.col("n") == 1, F.col("one.text")).otherwise(trim(F.expr(best_text))).alias("text")
    number = (F.row_number().over(Window.partitionBy("observation_id").orderBy("root")) - 1).alias("fused_ord")
    out = p.select("observation_id", number, *chosen, text, F.lit(None).cast("int").alias("region_index"), F.expr("array_distinct(transform(r, x -> x.source))").alias("sources"), F.expr(evidence).alias("evidence"))
    return out.select("observation_id", "fused_ord", *DETECTION_COLUMNS, "sources", "evidence")


def fuse(detections: DataFrame, observations: DataFrame) -> DataFrame:
    """Canonical entities of filtered detections."""
    return canonical(clusters(prepared(detections, observations)))


def fusion_trace(detections: DataFrame, fused: DataFrame) -> DataFrame:
    raw = detections.groupBy("observation_id").agg(F.count(F.lit(1)).alias("raw_detections"))
    made = fused.groupBy("observation_id").agg(F.count(F.lit(1)).alias("fused_detections"), F.count_if(F.size("evidence") > 1).alias("merged_groups"))
    return raw.join(made, "observation_id", "left")
