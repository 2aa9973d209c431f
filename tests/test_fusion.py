import random

import pytest
from tests.fixtures import box, detection, observation
from veilwright import schemas
from veilwright.operators import context, fusion, gate, redact_image
from veilwright.stages import Tables


def fuse(spark, rows, **o):
    d = spark.createDataFrame(rows, schemas.DETECTIONS)
    return fusion.fuse(d, spark.createDataFrame([observation(**o)], schemas.OBSERVATIONS)).orderBy("fused_ord").collect()


def test_same_element_merges_even_different_texts(spark):
    got = fuse(spark, [detection(0, "EMAIL", "a@b.co", element_id="e1"), detection(1, "EMAIL", "c@d.co", element_id="e1"), detection(2, "EMAIL", "a@b.co", element_id="e2")])
    assert [(x.source, len(x.evidence)) for x in got] == [("FUSED", 2), ("DOM_TEXT", 1)]


def test_equal_text_by_source_and_place(spark):
    near, far = box(0, 0, 50, 10), box(0, 300, 50, 10)
    assert len(fuse(spark, [detection(0, "PHONE", "98765 43210", bbox=near), detection(1, "PHONE", "9876543210", bbox=far)])) == 2
    assert len(fuse(spark, [detection(0, "PHONE", "98765 43210", bbox=near), detection(1, "PHONE", "9876543210", bbox=box(0, 20, 50, 10))])) == 1
    across = fuse(spark, [detection(0, "PHONE", "9876543210", bbox=None), detection(1, "PHONE", "9876543210", "OCR", bbox=far, ocr=0.4)])
    assert len(across) == 1 and across[0].sources == ["DOM_TEXT", "OCR"] and across[0].confidence == pytest.approx(0.9 + 0.1 * 0.15 * 0.9, abs=1e-3)
    assert across[0].ocr_confidence == 0.4 and tuple(across[0].bbox) == (0, 150, 25, 5)  # canvas pixels became viewport pixels
    assert len(fuse(spark, [detection(0, "PHONE", "9876543210"), detection(1, "CARD", "9876543210", "OCR")])) == 2


def test_structural_row_takes_in_what_it_contains(spark):
    got = fuse(spark, [detection(0, "EMAIL", None, "DOM", bbox=box(0, 0, 200, 30), conf=1.0, element_id="e1"), detection(1, "EMAIL", "a@b.co", bbox=box(10, 5, 40, 10), element_id=None), detection(2, "EMAIL", "x@y.co", bbox=box(500, 5, 40, 10))])
    assert [len(x.evidence) for x in got] == [2, 1] and got[0].text == "a@b.co" and got[0].element_id == "e1"


def test_structural_row_needs_both_boxes(spark):
    rows = [detection(0, "EMAIL", None, "DOM", bbox=box(0, 0, 200, 30), element_id="e1"), detection(1, "EMAIL", "a@b.co", bbox=None), detection(2, "EMAIL", None, "DOM", bbox=None, element_id="e2"), detection(3, "EMAIL", "c@d.co", bbox=box(10, 5, 40, 10))]
    assert [len(x.evidence) for x in fuse(spark, rows)] == [2, 1, 1]


def test_fuzzy_chain_stops_at_inconsistent_sets(spark):
    texts = ["abcdefghij", "abcdefghiX", "abcdefgYYX"]  # 0 ~ 1; 1 and 2 differ by two of ten
    at = [box(10 * k, 0, 60, 10) for k in range(3)]
    got = fuse(spark, [detection(k, "NAME", t, "RAMPART", "DOM", bbox=b) for k, (t, b) in enumerate(zip(texts, at))])
    assert sorted(len(x.evidence) for x in got) == [1, 2]
    spread = [box(0, 0, 10, 10), box(70, 0, 10, 10), box(140, 0, 10, 10)]
    chain = fuse(spark, [detection(k, "NAME", t, "RAMPART", "DOM", bbox=b) for k, (t, b) in enumerate(zip(["jonathan smith", "jonathan smyth", "jonathan smitt"], spread))])
    assert sorted(len(x.evidence) for x in chain) == [1, 2]  # the third is over 100 px from the first


def model_roots(rows):
    """All pairs in order, exact links first, then fuzzy links if every cross pair is consistent."""
    n = len(rows)
    group = list(range(n))

    def norm(r):
        return " ".join((r[6] or "").lower().split())

    def dist(p, q):
        return ((p["x"] + p["width"] / 2 - q["x"] - q["width"] / 2) ** 2 + (p["y"] + p["height"] / 2 - q["y"] - q["height"] / 2) ** 2) ** 0.5

    def iou(p, q):
        w = max(0, min(p["x"] + p["width"], q["x"] + q["width"]) - max(p["x"], q["x"]))
        h = max(0, min(p["y"] + p["height"], q["y"] + q["height"]) - max(p["y"], q["y"]))
        return w * h / (p["width"] * p["height"] + q["width"] * q["height"] - w * h) if w * h else 0.0

    def sim(a, b):
        return 1 - fusion.edit_distance(a, b) / max(len(a), len(b)) if a and b else float(a == b)

    def dice(a, b):
        x, y = a.split(), b.split()
        return 2 * sum(t in y for t in x) / (len(x) + len(y)) if len(x) > 1 and len(y) > 1 else 0

    fuzzy = []
    for i in range(n):
        for j in range(i + 1, n):
            a, b, p, q = norm(rows[i]), norm(rows[j]), rows[i][9], rows[j][9]
            if not a or not b:
                continue
            if a == b:
                same = rows[i][3] == rows[j][3]
                hit = bool(p and q and (iou(p, q) > 0.3 or dist(p, q) < 35)) if same else (not (p and q) or iou(p, q) > 0 or dist(p, q) < 200)
                if hit:
                    old, new = group[j], group[i]
                    group = [new if g == old else g for g in group]
            elif (sim(a, b) >= 0.85 or dice(a, b) >= 0.8) and p and q and (iou(p, q) > 0.2 or dist(p, q) < 80):
                fuzzy.append((i, j))
    for i, j in fuzzy:
        if group[i] != group[j]:
            one = [k for k in range(n) if group[k] == group[i]]
            two = [k for k in range(n) if group[k] == group[j]]
            if all((norm(rows[x]) == norm(rows[y]) or sim(norm(rows[x]), norm(rows[y])) >= 0.75) and (not (rows[x][9] and rows[y][9]) or iou(rows[x][9], rows[y][9]) > 0 or dist(rows[x][9], rows[y][9]) <= 100) for x in one for y in two):
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    return [min(k for k in range(n) if group[k] == g) for g in group]


def test_clusters_equal_a_sequential_model(spark):
    rnd = random.Random(9)
    rows, wanted = [], {}
    for o in range(60):
        own = []
        for k in range(rnd.randint(1, 8)):
            text = rnd.choice(["jonathansmith", "jonathansmyth", "jonathanxmyth", "mariagarcia"])
            own.append(detection(k, "NAME", text, rnd.choice(["RAMPART", "OTHER"]), "DOM", bbox=rnd.choice([None, box(rnd.randint(0, 200), rnd.randint(0, 60), 60, 12)]), obs=f"o{o}"))
        rows += own
        wanted[f"o{o}"] = model_roots(own)
    tables = Tables(spark, "test")
    d = tables.write(spark.createDataFrame(rows, schemas.DETECTIONS).repartition(7))
    obs = spark.createDataFrame([observation(f"o{o}") for o in range(60)], schemas.OBSERVATIONS)
    got = {o: [0] * len(v) for o, v in wanted.items()}
    for r in fusion.clusters(fusion.prepared(d, obs)).select("observation_id", "det_ord", "root").collect():
        got[r[0]][r[1]] = r[2]
    assert got == wanted


def test_context_filter(spark):
    def ner(k, type, text="x", conf=0.9, bbox=None, context="DOM", region_index=None, **more):
        return detection(k, type, text, "RAMPART", context, bbox, conf, region_index=region_index, reason=f"rampart-ner:{type}", **more)

    rows = [
        detection(0, "EMAIL", "a@b.co"),
        ner(1, "EMAIL", "a@b.co"),
        ner(2, "GIVEN_NAME", "John", region_index=3),
        ner(3, "SURNAME", "Smith", region_index=4),
        ner(4, "GIVEN_NAME", "Alice", region_index=9),
        ner(5, "NAME", "Mary Jane", region_index=20),
        ner(6, "SURNAME", "Low", conf=0.3, region_index=3),
        ner(7, "CITY", "Paris", bbox=box(0, 0, 40, 10)),
        ner(8, "ZIP_CODE", "75001", bbox=box(100, 0, 40, 10)),
        ner(9, "CITY", "Lone", bbox=box(0, 900, 40, 10)),
        ner(10, "AGE", "44"),
        ner(11, "STREET_NAME", "Main", conf=85.0, bbox=None, context="OCR"),
        ner(12, "BUILDING_NUMBER", "1", bbox=None, context="OCR"),
    ]
    d = Tables(spark, "test").write(spark.createDataFrame(rows, schemas.DETECTIONS))
    o = spark.createDataFrame([observation()], schemas.OBSERVATIONS)
    kept = context.context_filter(d, o)
    assert [(x.type, x.text) for x in kept.orderBy("det_ord").collect()] == [
        ("EMAIL", "a@b.co"),
        ("AGE", "44"),
        ("GIVEN_NAME", "John"),
        ("SURNAME", "Smith"),
        ("NAME", "Mary Jane"),
        ("CITY", "Paris"),
        ("ZIP_CODE", "75001"),
        ("STREET_NAME", "Main"),
        ("BUILDING_NUMBER", "1"),
    ]
    t = context.filter_trace(d, kept).first()
    assert (t.total_raw, t.tagged_before, t.tagged_rejected, t.tagged_low_confidence, t.passed_to_fusion) == (13, 12, 4, 1, 9)


def masks(spark, rows, **o):
    fused = spark.createDataFrame(rows, "observation_id string, fused_ord int, type string, bbox struct<x:double,y:double,width:double,height:double>, evidence array<struct<source:string,context_source:string,bbox:struct<x:double,y:double,width:double,height:double>>>")
    obs = spark.createDataFrame([observation(**o)], schemas.OBSERVATIONS)
    m = redact_image.mask_rectangles(fused, obs)
    return [(x.status, x.bbox and tuple(x.bbox), x.reason) for x in m.orderBy("fused_ord").collect()], redact_image.screen_results(m, obs).first()


def test_masks(spark):
    seen = [{"source": "OCR", "context_source": None, "bbox": box(1590, 790, 40, 40)}]
    got, result = masks(
        spark,
        [
            ("o1", 0, "EMAIL", box(10, 10, 100, 20), []),
            ("o1", 1, "EMAIL", box(10, 10, 100, 20), seen),
            ("o1", 2, "EMAIL", box(10, 900, 100, 20), []),
            ("o1", 3, "EMAIL", None, []),
            ("o1", 4, "EMAIL", None, [{"source": "DOM_TEXT", "context_source": None, "bbox": box(1, 1, 9, 9)}]),
        ],
    )
    assert got == [
        ("masked", (18, 18, 204, 44), None),
        ("masked", (1588, 788, 12, 12), None),
        ("offscreen", (20, 1800, 200, 40), "outside_screenshot_viewport"),
        ("unmasked", None, "unmappable_visual_coordinates"),
    ]
    assert result.success and not result.visual_complete and (result.masked_count, result.offscreen_count, result.unmasked_count) == (2, 1, 1)
    none, result = masks(spark, [("o1", 0, "EMAIL", box(1, 1, 9, 9), [])], canvas=None)
    assert none == [] and not result.success


GATE = gate.ROWS
GOOD = {"observation_id": "o", "url": "https://a.com/x?y", "goal": "g", "available_actions": None, "canvas": (10, 10), "sanitized_text": "t", "n_regions": 1, "n_fused": 1, "text_complete": True, "n_unredacted": 0, "success": True, "data_url": "data:image/png;base64,A", "has_canvas": False, "visual_complete": True, "n_unmasked": 0}


@pytest.mark.parametrize(
    ("change", "reasons"),
    [
        ({}, []),
        ({"sanitized_text": None}, ["SANITIZED_DOM_MISSING"]),
        ({"sanitized_text": "  "}, ["SANITIZED_DOM_EMPTY"]),
        ({"sanitized_text": "", "n_regions": 0}, []),
        ({"canvas": None}, ["SANITIZED_SCREENSHOT_MISSING", "VISUAL_REDACTION_NOT_PERFORMED"]),
        ({"success": None}, ["SANITIZED_SCREENSHOT_MISSING"]),
        ({"success": False}, ["SANITIZED_SCREENSHOT_FAILED"]),
        ({"data_url": "x"}, ["SANITIZED_SCREENSHOT_INVALID_OUTPUT"]),
        ({"text_complete": None}, ["TEXT_REDACTION_METADATA_MISSING"]),
        ({"text_complete": False}, ["TEXT_REDACTION_INCOMPLETE"]),
        ({"n_unredacted": 2}, ["UNREDACTED_TEXT_DETECTED"]),
        ({"visual_complete": None}, ["VISUAL_REDACTION_METADATA_MISSING"]),
        ({"visual_complete": False}, ["VISUAL_REDACTION_INCOMPLETE"]),
        ({"n_unmasked": 1}, ["UNMASKED_VISUAL_REGIONS_DETECTED"]),
        ({"n_fused": 0, "text_complete": None, "visual_complete": None}, []),
    ],
)
def test_gate(spark, change, reasons):
    row = GOOD | change
    v = gate.gate(spark.createDataFrame([tuple(row[x.split()[0]] for x in GATE.split(", "))], GATE)).first()
    assert v.reasons == reasons and v.allowed == (not reasons) and (v.outbound is None) == bool(reasons)
    assert v.allowed == all(v.checks)
    if not reasons:
        assert v.outbound.page.url == "https://a.com/x" and len(v.outbound.available_actions) == 6


def test_shut_gate(spark):
    v = gate.shut(spark.createDataFrame([("a",), (None,)], "observation_id string"))
    assert v.schema.names == gate.gate(spark.createDataFrame([], GATE)).schema.names
    assert all(not r.allowed and r.reasons == ["PRIVACY_GATE_UNAVAILABLE"] and r.outbound is None and not any(r.checks) for r in v.collect())


def test_forbidden_keys(spark):
    kind = spark.createDataFrame([], "a struct<x:array<struct<Password:string>>>, m map<string,struct<trace:int>>, passwords string").schema
    assert gate.forbidden_fields(kind) == ["Password", "trace"]
    d = spark.createDataFrame([('{"a":[{"APIKEY":1}]}',), ('{"a":"password"}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in d.select(gate.json_holds_forbidden_key("j")).collect()] == [True, False, True, True]
