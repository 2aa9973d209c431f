"""Context filter: tagger output needs support, everything else passes untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.config import ADDRESS_TYPES, DEFAULT_THRESHOLD, NAME_TYPES, STRUCTURED_TYPES, THRESHOLDS
from veilwright.functions.geometry import centre_distance, normalize_box, scale
from veilwright.functions.text import region_of, rescale_confidence, trim
from veilwright.operators.graph import breadth_first, per_observation
from veilwright.schemas import DETECTION_COLUMNS

NEAR, NEAR_ROW, NEAR_COLUMN, NEAR_STEPS = 180.0, 50.0, 250.0, 2


def threshold(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_THRESHOLD))


def route(kind: Column, source: Column, confidence: Column) -> Column:
    """pass, structured, low, name or address: what the filter does with a detection at first."""
    return (
        F.when(F.coalesce(source != "RAMPART", F.lit(True)), "pass")
        .when(kind.isin(*STRUCTURED_TYPES), "structured")
        .when(rescale_confidence(confidence) < threshold(kind), "low")
        .when(kind.isin(*NAME_TYPES), "name")
        .when(kind.isin(*ADDRESS_TYPES), "address")
        .otherwise("pass")
    )


def with_scale(detections: DataFrame, observations: DataFrame) -> DataFrame:
    """``detections`` with ``by``, the canvas scale of their observation."""
    by = observations.select("observation_id", scale(F.col("viewport"), F.col("canvas"), F.col("dpr")).alias("by"))
    return detections.join(by, "observation_id", "left")


def _complements(a: Column, b: Column, with_names: bool) -> Column:
    pair = ((a == "SURNAME") & b.isin("GIVEN_NAME", "NAME")) | ((a == "GIVEN_NAME") & b.isin("SURNAME", "NAME"))
    return pair | ((a == "NAME") & b.isin(*NAME_TYPES)) if with_names else pair


def supported_names(names: DataFrame) -> DataFrame:
    """The name candidates with form context, two tokens, or a complementary name nearby (or, if recognised, anywhere recognised)."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    formal = (F.coalesce("element_id", F.lit("")) != "") | reason.rlike(r"^(input\[|autocomplete)|name-field|form")
    tokens = F.size(F.filter(F.split(trim(F.coalesce("text", F.lit(""))), r"[\s ]+"), lambda w: w != ""))
    own = names.withColumn("region", region_of(F.col("region_index"), F.col("reason"))).withColumn("alone_ok", formal | (tokens >= 2))
    alone = own.where("not alone_ok")
    o = own.select(F.col("observation_id").alias("oo"), F.col("det_ord").alias("od"), F.col("type").alias("ot"), F.col("region").alias("oregion"), F.col("context_source").alias("oc"))
    # partners nearby meet by region; a recognised partner has another type, so it is enough to know which types there are
    around = alone.select("observation_id", "det_ord", "type", F.explode(F.expr("case when region is not null then sequence(region - 1, region + 1) end")).alias("at"))
    nearby = around.join(o, (F.col("observation_id") == F.col("oo")) & (F.col("at") == F.col("oregion")) & (F.col("det_ord") != F.col("od")) & _complements(F.col("type"), F.col("ot"), True), "left_semi")
    kinds = o.where("oc = 'OCR'").select("oo", "ot").distinct()
    seen = alone.where("context_source = 'OCR'").join(kinds, (F.col("observation_id") == F.col("oo")) & _complements(F.col("type"), F.col("ot"), False), "left_semi")
    partner = nearby.select("observation_id", "det_ord").union(seen.select("observation_id", "det_ord")).distinct()
    return own.where("alone_ok").unionByName(alone.join(partner, ["observation_id", "det_ord"], "left_semi")).drop("region", "alone_ok")


def nearby_addresses(a: Column, b: Column, same_context: Column, steps: Column) -> Column:
    """Whether two address parts belong together: by boxes, or in sequence where a box is missing."""
    down = F.abs((a["y"] + a["height"] / 2) - (b["y"] + b["height"] / 2))
    across = F.abs((a["x"] + a["width"] / 2) - (b["x"] + b["width"] / 2))
    boxed = (centre_distance(a, b) <= NEAR) | ((down <= NEAR_ROW) & (across <= NEAR_COLUMN))
    return F.when(a.isNotNull() & b.isNotNull(), boxed).otherwise(F.coalesce(same_context, F.lit(False)) & (steps <= NEAR_STEPS))


def address_links(addresses: DataFrame) -> DataFrame:
    """(observation_id, i, j) of address parts that belong together; needs ``box``.

    Parts with boxes meet in the cells of a grid as wide as the rule reaches and their neighbours, others by
    their distance in sequence; so a crowded observation does not pair everything.
    """
    cell = [F.floor((F.col("box")[p] + F.col("box")[s] / 2) / reach).alias(c) for p, s, reach, c in (("x", "width", NEAR_COLUMN, "cx"), ("y", "height", NEAR, "cy"))]
    placed = addresses.select("observation_id", "det_ord", "box", "context_source", *cell)
    b = placed.select("observation_id", F.col("det_ord").alias("j"), F.col("box").alias("b"), F.col("context_source").alias("cb"), "cx", "cy")
    a = placed.select("observation_id", F.col("det_ord").alias("i"), F.col("box").alias("a"), F.col("context_source").alias("ca"), "cx", "cy")
    near = nearby_addresses(F.col("a"), F.col("b"), F.col("ca") == F.col("cb"), F.abs(F.col("i") - F.col("j")))
    around = F.explode(F.expr("flatten(transform(sequence(cx - 1, cx + 1), x -> transform(sequence(cy - 1, cy + 1), y -> named_struct('cx', x, 'cy', y))))"))
    boxed = a.where("cx is not null and cy is not null").select("observation_id", "i", "a", "ca", around.alias("c")).select("observation_id", "i", "a", "ca", "c.*")
    by_place = boxed.join(b, ["observation_id", "cx", "cy"]).where((F.col("i") < F.col("j")) & near)
    after = a.drop("cx", "cy").withColumn("j", F.explode(F.expr(f"sequence(i + 1, i + {NEAR_STEPS})")))
    by_order = after.join(b.drop("cx", "cy"), ["observation_id", "j"]).where((F.col("a").isNull() | F.col("b").isNull()) & near)
    return by_place.select("observation_id", "i", "j").union(by_order.select("observation_id", "i", "j"))


def valid_cluster(types: Column) -> Column:
    """Whether a set of distinct address types is an address."""
    has = {t: F.array_contains(types, t) for t in ADDRESS_TYPES}
    place = has["CITY"] | has["STATE"] | has["ZIP_CODE"]
    two = (has["CITY"] & has["STATE"]) | (has["CITY"] & has["ZIP_CODE"]) | (has["STATE"] & has["ZIP_CODE"])
    street, number = has["STREET_NAME"], has["BUILDING_NUMBER"]
    return (number & street) | (street & (place | has["SECONDARY_ADDRESS"])) | (number & place) | two | (F.size(types) >= 3)


def address_clusters(addresses: DataFrame) -> DataFrame:
    """Address parts with ``cluster`` (its first det_ord), ``visit`` (rank in it) and ``valid``."""
    visits = per_observation(address_links(addresses), breadth_first, ("root", "visit"))
    placed = addresses.join(visits, ["observation_id", "det_ord"], "left")
    placed = placed.withColumn("cluster", F.coalesce("root", "det_ord")).withColumn("visit", F.coalesce("visit", F.lit(0))).drop("root")
    w = Window.partitionBy("observation_id", "cluster")
    return placed.withColumn("valid", (F.count(F.lit(1)).over(w) >= 2) & valid_cluster(F.collect_set("type").over(w)))


def context_filter(detections: DataFrame, observations: DataFrame) -> DataFrame:
    """The kept detections, renumbered in the filter's order: untouched ones, names, address clusters."""
    routed = detections.withColumn("route", route(F.col("type"), F.col("source"), F.col("confidence")))
    passed = routed.where("route = 'pass'").withColumns({"band": F.lit(0), "o1": F.col("det_ord"), "o2": F.lit(0)})
    names = supported_names(routed.where("route = 'name'")).withColumns({"band": F.lit(1), "o1": F.col("det_ord"), "o2": F.lit(0)})
    boxed = with_scale(routed.where("route = 'address'"), observations).withColumn("box", normalize_box(F.col("bbox"), F.col("source"), F.col("context_source"), F.col("by")))
    found = address_clusters(boxed).where("valid").withColumns({"band": F.lit(2), "o1": F.col("cluster"), "o2": F.col("visit")})
    columns = ["observation_id", "band", "o1", "o2", *DETECTION_COLUMNS]
    kept = passed.select(columns).unionByName(names.select(columns)).unionByName(found.select(columns))
    order = Window.partitionBy("observation_id").orderBy("band", "o1", "o2")
    return kept.select("observation_id", (F.row_number().over(order) - 1).alias("det_ord"), *DETECTION_COLUMNS)


def filter_trace(detections: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts per observation of what the filter saw, rejected and passed on."""
    routed = detections.withColumn("route", route(F.col("type"), F.col("source"), F.col("confidence")))
    before = routed.groupBy("observation_id").agg(F.count(F.lit(1)).alias("total_raw"), F.count_if(F.col("source") == "RAMPART").alias("tagged_before"), F.count_if(F.col("route") == "low").alias("tagged_low_confidence"))
    after = kept.groupBy("observation_id").agg(F.count(F.lit(1)).alias("passed_to_fusion"))
    trace = before.join(after, "observation_id", "left").withColumn("passed_to_fusion", F.coalesce("passed_to_fusion", F.lit(0)))
    return trace.withColumn("tagged_rejected", F.col("total_raw") - F.col("passed_to_fusion"))
