import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import box, element, observation, region
from veilwright import schemas
from veilwright.config import EngineConfig
from veilwright.operators import redact_text as R
from veilwright.plans.pipeline import Inputs, execute
from veilwright.sources import images, ocr


def evidence(source, text, context=None, start=None, end=None, reason="r", element_id=None, bbox=None):
    return {"source": source, "context_source": context, "text": text, "start": start, "end": end, "reason": reason, "element_id": element_id, "bbox": bbox, "confidence": 0.9, "ocr_confidence": None}


def entity(kind, text, *rows, k=0, source=None, context=None, bbox=None, element_id=None):
    return {"fused_ord": k, "type": kind, "text": text, "source": source or rows[0]["source"], "context_source": context or rows[0]["context_source"], "element_id": element_id, "reason": rows[0]["reason"], "bbox": bbox, "sources": [r["source"] for r in rows], "evidence": list(rows)}


def page(entities, *texts, config=EngineConfig()):
    return R.redact_page([{"region_index": k, "text": t, "bbox": box(0, 100 * k, 200, 20)} for k, t in enumerate(texts)], entities, config)


def test_offsets_and_all_occurrences():
    exact = entity("EMAIL", "a@b.co", evidence("DOM_TEXT", "a@b.co", start=5, end=11, reason="email-regex:reg0"))
    got = page([exact], "mail a@b.co and a@b.co", "a@b.co")
    assert got["sanitized_text"] == "mail [EMAIL] and a@b.co\n[EMAIL]"  # offsets name one place; other regions fall back to the text
    loose = entity("EMAIL", "a@b.co", evidence("DOM_TEXT", "a@b.co", reason="email-regex:reg0"))
    assert page([loose], "mail a@b.co and A@B.co a@b.co", "a@b.co")["sanitized_text"] == "mail [EMAIL] and A@B.co [EMAIL]\n[EMAIL]"


def test_overlaps_merge_and_touching_does_not():
    card = entity("CARD", "4111 1198765 43210", evidence("DOM_TEXT", "4111 1198765 43210", start=0, end=18))
    phone = entity("PHONE", "98765 43210", evidence("DOM_TEXT", "98765 43210", start=7, end=18), k=1)
    got = page([card, phone], "4111 1198765 43210 end")
    assert got["sanitized_text"] == "[CARD] end" and got["summary"]["covered"] == 1 and got["complete"]
    a, b = (entity("NAME", t, evidence("DOM_TEXT", t, start=s, end=s + 2), k=k) for k, (t, s) in enumerate((("ab", 0), ("cd", 2))))
    assert page([a, b], "abcd")["sanitized_text"] == "[PERSON][PERSON]"
    weak = entity("NAME", "ann@x", evidence("DOM_TEXT", "ann@x", start=0, end=5))
    mail = entity("EMAIL", "n@x.co", evidence("DOM_TEXT", "n@x.co", start=2, end=8), k=1)
    assert page([weak, mail], "ann@x.co")["sanitized_text"] == "[EMAIL]"


def test_recognised_text_needs_its_place():
    near = entity("EMAIL", "a@b.co", evidence("OCR", "a@b.co"), bbox=box(0, 100, 50, 10))
    got = page([near], "a@b.co", "write A@B.co")
    assert got["sanitized_text"] == "a@b.co\nwrite [EMAIL]"
    assert [r["provenance"] for r in got["redactions"]] == ["ocr_spatial_grounded_unique"]


def test_accents_and_failures():
    name = entity("SURNAME", "Wingardh", evidence("RAMPART", "wingardh", "DOM", 0, 3, "rampart-ner:SURNAME:reg0"))
    assert page([name], "Herr Wingårdh här")["sanitized_text"] == "Herr [PERSON] här"
    missing = entity("NAME", "Nobody", evidence("RAMPART", "Nobody", "DOM", reason="rampart-ner:NAME:reg0"))
    got = page([missing], "text")
    assert not got["complete"] and got["unredacted"] == [{"fused_ord": 0, "type": "NAME", "reason": R.NOT_FOUND}]
    inside = entity("SURNAME", "PERSON", evidence("RAMPART", "PERSON", "DOM", 0, 6))
    assert page([inside], "PERSON x")["unredacted"][0]["reason"] == R.PERSISTS
    assert page([entity("PASSWORD", None, evidence("DOM", None), element_id="e1")], "x")["complete"]
    assert R.redact_page([], [missing])["complete"]


def test_strict_redacts_every_evidence():
    two = entity("EMAIL", "a@b.co", evidence("DOM_TEXT", "a@b.co", reason="x:reg0"), evidence("DOM_TEXT", "c@d.co", reason="x:reg0"), element_id="e1")
    assert page([two], "a@b.co c@d.co")["sanitized_text"] == "[EMAIL] c@d.co"
    assert page([two], "a@b.co c@d.co", config=EngineConfig(strict=True))["sanitized_text"] == "[EMAIL] [EMAIL]"


def test_standalone_text():
    e = [entity("EMAIL", "a@b.co", evidence("OCR", "a@b.co")), entity("NAME", "Al", evidence("RAMPART", "Al", "DOM", 7, 9))]
    assert R.redact_text("a@b.co Al Also a@b.co", e) == ("[EMAIL] [PERSON] Also [EMAIL]", 3)
    assert R.redact_text(None, e) == ("", 0)


def test_native_islands_equal_the_sequential_ones(spark):
    rnd = random.Random(3)
    rows, wanted = [], {}
    text = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    for k in range(200):
        spans = [R.Span(s, s + rnd.randint(1, 9), rnd.choice(["[EMAIL]", "[PERSON]", "[REDACTED]", "[CARD]", "[ADDRESS]"]), "") for s in (rnd.randint(0, 50) for _ in range(rnd.randint(0, 6)))]
        spans = sorted({(s.start, s.end): s for s in spans}.values(), key=lambda s: (s.start, -s.end))
        wanted[k] = R.rebuild(text, R.merge(spans))
        rows += [(k, d, s.start, s.end, s.placeholder) for d, s in enumerate(spans)]
    texts = spark.createDataFrame([(k, text) for k in wanted], "k int, text string")
    spans = spark.createDataFrame(rows, "k int, det_ord int, start int, end int, placeholder string")
    assert {r.k: r.text for r in R.apply_islands(texts, spans, "k").collect()} == wanted
    packed = spans.groupBy("k").agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("placeholder").alias("p"))).alias("a"))
    folded = texts.join(packed, "k").withColumn("i", F.expr(R.row_islands_sql("a"))).select("k", R.replaced("text", "i").alias("text"))
    assert all(wanted[r.k] == r.text for r in folded.collect())


@pytest.fixture(scope="module")
def run(spark):
    obs = spark.createDataFrame([observation(), observation("o2", "ftp://x", None, None)], schemas.OBSERVATIONS)
    elements = spark.createDataFrame([element(0, "input", "password", "user_pass"), element(1, "input", "email"), element(2, "input", "tel"), element(3, "input", "text", "search_query")], schemas.ELEMENTS)
    texts = ["Support contact: support@example.com for help.", "Emergency helpline: 9876543210 available 24/7.", "Test Card: 4111 1111 1111 1111 (Visa).", "My name is John Smith.", "I live at 123 Main Street in Paris", "Alice was here"]
    regions = spark.createDataFrame([region(k, t) for k, t in enumerate(texts)] + [region(0, "nothing", "o2")], schemas.REGIONS)
    words = [("o1", 0, "Event", None, box(40, 300, 80, 32)), ("o1", 1, "organizer@example.com", None, box(150, 300, 300, 32)), ("o1", 2, "Phone:", None, box(40, 460, 90, 32)), ("o1", 3, "9876543210", 0.2, box(380, 460, 160, 32))]
    screen = spark.createDataFrame([("o1", 1600, 800, bytearray(np.full((800, 1600, 4), 255, np.uint8).tobytes()))], "observation_id string, width int, height int, rgba binary")
    return execute(Inputs(obs, elements, regions, spark.createDataFrame(words, schemas.OCR_WORDS), images=screen))


def test_pipeline(run):
    raw = run.detections.where("observation_id = 'o1'").collect()
    assert sum(x.source == "DOM" and x.text is None for x in raw) == 3
    assert sorted(x.type for x in raw if x.source == "DOM_TEXT") == ["CARD", "EMAIL", "PHONE"]
    assert sorted(x.type for x in raw if x.source == "OCR") == ["EMAIL", "PHONE"]
    street = next(x for x in raw if x.type == "STREET_NAME")
    assert street.text == "Main Street" and (street.bbox.x, street.bbox.width) == (20 + 8 * 14, 88)
    kept = [x.text for x in run.filtered.where("source = 'RAMPART'").collect()]
    assert "Alice" not in kept and {"John", "Smith", "Paris"} <= set(kept)
    r = {x.observation_id: x for x in run.redaction.collect()}
    assert r["o1"].sanitized_text.split("\n") == ["Support contact: [EMAIL] for help.", "Emergency helpline: [PHONE] available 24/7.", "Test Card: [CARD] (Visa).", "My name is [PERSON] [PERSON].", "I live at [ADDRESS] [ADDRESS] in [ADDRESS]", "Alice was here"]
    v = {x.observation_id: x for x in run.verdicts.collect()}
    assert v["o1"].allowed and v["o1"].outbound.page.url == "https://ex.com/a"
    assert not v["o2"].allowed and v["o2"].outbound is None
    png = images.png_decode(__import__("base64").b64decode(v["o1"].outbound.visual.screenshot.split(",")[1]))
    assert png[30, 30].tolist() == [0, 0, 0, 255] and png[790, 1590].tolist() == [255] * 4


def test_stages_do_not_depend_on_partitions(run):
    assert run.trace.where("observation_id = 'o1'").first().n_fused == run.fused.where("observation_id = 'o1'").count()


def test_ocr_lines():
    def word(text, x, y, w=30, h=10, c=0.9):
        return {"text": text, "bbox": box(x, y, w, h), "confidence": c, "start": None, "end": None}

    lines = ocr.build_lines([word("b", 40, 2), word("a", 0, 0), word("far", 300, 1), word("next", 0, 40), word(" ", 0, 0), {"text": "x", "bbox": None}])
    assert [x["text"] for x in lines] == ["a b", "far", "next"]
    assert lines[0]["bbox"] == box(0, 0, 70, 12)
    assert [x["text"] for x in ocr.simple_lines([word("b", 40, 2), word("a", 0, 0), word("far", 300, 1), word("next", 0, 40)])] == ["a b far", "next"]


def test_images(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (images.png_decode(images.png_encode(p)) == p).all()
    assert images.upscaled(p, 2).shape == (14, 10, 4) and images.upscaled(p, -1).shape == (14, 10, 4) and (images.upscaled(p, 2)[::2, ::2] == p).all()
    q = np.zeros((2, 2, 4), np.uint8)
    q[0, 0] = (1, 0, 0, 255)
    q[0, 1] = (9, 9, 9, 0)
    rows = spark.createDataFrame([("a", 2, 2, bytearray(q.tobytes())), ("b", 0, 0, None)], "observation_id string, width int, height int, rgba binary")
    got = {r.observation_id: r for r in images.pixel_stats(rows).collect()}
    assert (got["a"].non_zero_pixels, got["a"].non_zero_percent, got["a"].has_data) == (1, 25.0, True) and not got["b"].has_data
    assert images.upscale_images(rows.where("width > 0"), 2).first().width == 4 and images.test_card().shape == (400, 800, 4)


def test_regions_that_are_passed_over_have_nothing_to_find():
    """Skipping a region for an entity must not change the result: against a mapping of every pair."""
    import random

    from veilwright.config import DEFAULT
    from veilwright.operators import redact_text as R

    rnd = random.Random(5)
    values = ["José Núñez", "jose nunez", "a@b.co", "A@B.CO", "ΟΔΟΣ", "Straße", "98765 43210", "x"]
    for _ in range(400):
        regions = [{"region_index": k, "text": rnd.choice(["", "the "]) + " and ".join(rnd.choices([*values, "nothing", "José", "ΟΔΟΣ Α"], k=rnd.randint(0, 4))), "bbox": rnd.choice([None, {"x": 0.0, "y": 20.0 * k, "width": 90.0, "height": 16.0}])} for k in range(rnd.randint(1, 4))]
        entities = []
        for k in range(rnd.randint(0, 3)):
            text = rnd.choice([*values, None, " "])
            source, context = rnd.choice([("DOM_TEXT", None), ("RAMPART", "DOM"), ("OCR", None), ("RAMPART", "OCR"), ("DOM", None)])
            start = rnd.choice([None, 0, 4])
            own = {"source": source, "context_source": context, "text": rnd.choice([text, rnd.choice(values)]), "reason": rnd.choice([None, "email-regex:reg1", "r"]), "start": start, "end": None if start is None else start + rnd.randint(1, 12), "bbox": None, "element_id": None}
            entities.append({"fused_ord": k, "type": "EMAIL", "source": source, "context_source": context, "element_id": None, "text": text, "reason": own["reason"], "bbox": rnd.choice([None, {"x": 0.0, "y": 0.0, "width": 50.0, "height": 16.0}]), "sources": [source], "evidence": rnd.choice([[own], [own, own], [], None])})
        got = R.redact_page(regions, entities)
        for region, shown in zip(regions, got["regions"]):
            spans = [R.Span(a, b, R.placeholder_of(e["type"]), name, e["fused_ord"]) for e in entities for a, b, name in R.Mapper(region, e, DEFAULT).spans()]
            assert shown["text"] == R.rebuild(region["text"], R.merge(spans))
