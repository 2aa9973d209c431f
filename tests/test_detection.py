import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.fixtures import element, region
from veilwright import schemas
from veilwright.functions import text as T
from veilwright.functions.url import sanitize, sanitize_url
from veilwright.operators import detect, grounding, ner
from veilwright.sources import pages


def hits(spark, *texts, strict=False):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [[(x.type, x.text, x.start, x.end, x.confidence) for x in r.d] for r in d.select("i", T.detect("text", strict).alias("d")).orderBy("i").collect()]


def test_text_detector(spark):
    found = hits(
        spark,
        "Contact john@example.com or support@company.org for help.",
        "Call +91 9876543210 or 9876543210 or +91-9876543210 today",
        "Card: 4111 1111 1111 1111",
        "Card: 4111 1111 1111 1112",
        "Nothing sensitive here. Searching for RTX 4050 laptops under 60000 INR.",
        None,
        "",
        "éa@b.co",
    )
    assert [x[:2] for x in found[0]] == [("EMAIL", "john@example.com"), ("EMAIL", "support@company.org")]
    assert len(found[1]) == 3 and all(x[0] == "PHONE" and x[4] == 0.95 for x in found[1])
    assert found[2] == [("CARD", "4111 1111 1111 1111", 6, 25, 0.99)]
    assert found[3] == found[4] == found[5] == found[6] == []
    assert found[7] == [("EMAIL", "a@b.co", 1, 7, 0.99)]


def test_phone_tail_of_a_card_only_without_strict(spark):
    text = "x 41119876543210 y"
    assert [x[:2] for x in hits(spark, text)[0]] == [("PHONE", "9876543210")]
    assert hits(spark, text, strict=True) == [[]]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("ab1 9@.-\n+8", max_size=40), min_size=150, max_size=200))
def test_offsets_equal_those_of_a_sequential_search(spark, texts):
    ascii_email = re.compile(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", re.ASCII)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = d.select("i", F.expr(T.matches_sql("text", T.EMAIL)).alias("m")).orderBy("i").collect()
    assert [[(x.text, x.start, x.end) for x in r.m] for r in got] == [[(m[0], *m.span()) for m in ascii_email.finditer(t)] for t in texts]


def test_structural_rules_and_attributes(spark):
    rows = [
        element(0, "input", "password", "user_pass", "Enter password"),
        element(1, "input", "email", "user_email", "Email address"),
        element(2, "input", "tel", "mobile", "Phone number"),
        element(3, "input", "text", "username", "Enter your username"),
        element(4, "input", "text", "pass_field", None, "current-password"),
        element(5, "input", "text", "email_field", None, "email"),
        element(6, "a", text="mail a@b.co", acc="mail a@b.co and c@d.co c@d.co"),
        element(7, "input", "text", "user_password"),
        element(8, "a", text="Forgot password?", acc="Forgot password?"),
    ]
    found = detect.detect_elements(spark.createDataFrame(rows, schemas.ELEMENTS)).orderBy("at").collect()
    structural = [(x.element_id, x.type, x.confidence) for x in found if x.source == "DOM"]
    assert structural == [("e1", "PASSWORD", 1.0), ("e2", "EMAIL", 1.0), ("e3", "PHONE", 1.0), ("e5", "PASSWORD", 1.0), ("e6", "EMAIL", 1.0), ("e9", "PASSWORD", 0.95)]
    assert all(x.text is None and x.start is None for x in found if x.source == "DOM")
    assert "autocomplete" in next(x.reason for x in found if x.element_id == "e5")
    assert [x.text for x in found if x.element_id == "e7"] == ["a@b.co", "c@d.co"]


def test_regions_are_tagged(spark):
    r = spark.createDataFrame([region(0, "Support contact: support@example.com for help."), region(1, "Emergency helpline: 9876543210 available 24/7."), region(2, "Test Card: 4111 1111 1111 1111 (Visa).")], schemas.REGIONS)
    found = detect.detect_regions(r).orderBy("at").collect()
    assert [(x.type, x.reason) for x in found] == [("EMAIL", "email-regex:reg0"), ("PHONE", "indian-phone-regex:reg1"), ("CARD", "luhn-card-regex:reg2")]


def token(word, entity, k, score=0.9, start=None, end=None):
    return {"word": word, "entity": entity, "index": k, "score": score, "start": start, "end": end}


@pytest.mark.parametrize(
    ("text", "tokens", "expected"),
    [
        ("My name is John Smith.", [token("john", "B-GIVEN_NAME", 4), token("smith", "B-SURNAME", 5)], [("GIVEN_NAME", "John", 11, 15), ("SURNAME", "Smith", 16, 21)]),
        ("My email is john.smith@example.com.", [token(w, ("B" if not k else "I") + "-EMAIL", k) for k, w in enumerate(["john", ".", "smith", "@", "example", ".", "com"])], [("EMAIL", "john.smith@example.com", 12, 34)]),
        ("I live at 123 Main Street.", [token("123", "B-BUILDING_NUMBER", 4), token("main", "B-STREET_NAME", 5), token("street", "I-STREET_NAME", 6)], [("BUILDING_NUMBER", "123", 10, 13), ("STREET_NAME", "Main Street", 14, 25)]),
        ("My phone number is 9876543210.", [token("987", "B-PHONE", 5), token("##654", "I-PHONE", 6), token("##3210", "I-PHONE", 7)], [("PHONE", "9876543210", 19, 29)]),
        ("Kära Wingårdh", [token("wingardh", "B-SURNAME", 1)], [("SURNAME", "Wingårdh", 5, 13)]),
        ("no such words", [token("zzz", "B-CITY", 1), token("##x", "I-CITY", 2)], [("CITY", "zzzx", None, None)]),
        ("nothing", [token("nothing", "O", 0)], []),
    ],
)
def test_tokens_become_spans(text, tokens, expected):
    assert [(x["type"], x["text"], x["start"], x["end"]) for x in ner.entity_spans(text, tokens)] == expected


def test_native_grouping_equals_sequential_grouping(spark):
    import random

    rnd = random.Random(5)
    rows, wanted = [], {}
    for o in range(300):
        tokens, at = [], 0
        for _ in range(rnd.randint(0, 9)):
            at += rnd.choice([1, 1, 2])
            tokens.append(token(rnd.choice(["a", "##b", ".", "@"]), rnd.choice(["O", "B-EMAIL", "I-EMAIL", "EMAIL", "B-CITY", "I-CITY"]), at, rnd.random()))
        wanted[str(o)] = [(g["kind"], len(g["tokens"])) for g in ner.group_in_python(tokens)]
        rows += [(str(o), "DOM", 0, k, t["entity"], t["score"], t["index"], t["word"], None, None) for k, t in enumerate(tokens)]
    spans = ner.group_spans(ner.group_tokens(spark.createDataFrame(rows, schemas.TOKENS), "observation_id"), "observation_id")
    got = {}
    for r in spans.orderBy("observation_id", "group_no").collect():
        got.setdefault(r.observation_id, []).append((r.kind, len(r.tokens)))
    assert got == {k: v for k, v in wanted.items() if v}


def test_grounding(spark):
    def word(text, x, width, y, height=20, **k):
        return {"text": text, "bbox": {"x": float(x), "y": float(y), "width": float(width), "height": float(height)}, "confidence": None, "start": None, "end": None} | k

    name = [word("My", 10, 25, 100), word("name", 40, 45, 100), word("is", 90, 18, 100), word("John", 115, 42, 100), word("Smith.", 162, 55, 100)]
    live = [word("123", 84, 28, 200, 18), word("Main", 118, 42, 198), word("Street.", 166, 60, 200, 18)]
    a, b = "My name is John Smith.", "I live at 123 Main Street."
    rows = [(a, name, 11, 15), (a, name, 16, 21), (b, live, 10, 13), (b, live, 14, 25), (a, None, 11, 15), (a, name, -1, 4), (a, name, 5, 5), (a, name, None, 9), (a, name, 200, 210), (None, name, 3, 7)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, source_text string, w array<{schemas.WORD}>, start int, end int")
    for side in ({"dom_words": "w", "ocr_words": None}, {"dom_words": None, "ocr_words": "w"}):
        got = [r.bbox and tuple(r.bbox) for r in grounding.ground(d, **side).orderBy("k").collect()]
        assert got == [(115, 100, 42, 20), (162, 100, 55, 20), (84, 200, 28, 18), (118, 198, 108, 20), None, None, None, None, None, (40, 100, 45, 20)]


HTML = """<html><body><label for="p">Your password</label><input id="p" type="password" value="hidden-value"><textarea name="t">private words</textarea>
<select name="s"><option>one<option selected>two</select><a href="/x" title="go">Mail a@b.co</a><a name="no">plain</a><div style="display:none">unseen<button>no</button></div>
<div role="checkbox" aria-checked="true" tabindex="0">box</div><script>var x = "9876543210"</script><p>Text &amp; more  words</p></body></html>"""


def test_html_elements_and_regions(spark):
    p = spark.createDataFrame([(1, "http://a.example/", HTML), (2, "x", None), (3, "x", "")], "page_id long, url string, html string")
    e = pages.page_elements(p).orderBy("ord").collect()
    assert [(x.tag, x.role) for x in e] == [("input", "textbox"), ("textarea", "textbox"), ("select", "combobox"), ("a", "link"), ("div", "checkbox")]
    assert e[0].accessible_name == "Your password" and e[0].has_value and e[0].text == "" and e[1].text == ""
    assert e[2].selected == "two" and e[3].accessible_name == "go" and e[4].checked is True
    texts = [x.text for x in pages.page_regions(p).orderBy("region_index").collect()]
    assert "Text & more words" in texts and not any("hidden" in t or "unseen" in t or "9876543210" in t or "private" in t for t in texts)


@pytest.mark.parametrize(
    ("raw", "safe"),
    [
        ("https://u:p@H.com:443/a/../b?x=1#y", "https://h.com/b"),
        ("http://a.com:8080/", "http://a.com:8080/"),
        ("https://a.com", "https://a.com/"),
        ("ftp://a/b", ""),
        ("chrome-extension://abc/p.html?x", "chrome-extension://abc/p.html"),
        ("javascript:alert(1)", ""),
        ("nope", ""),
        (None, ""),
        ("http://exämple.com/ü x", "http://xn--exmple-cua.com/%C3%BC%20x"),
        ("https://a.example.com/p/q?x#y", "https://a.example.com/p/q"),
    ],
)
def test_sanitize_url(spark, raw, safe):
    assert sanitize(raw) == safe
    assert spark.createDataFrame([(raw,)], "u string").select(sanitize_url(F.col("u"))).first()[0] == safe


def test_similarity_and_rounding(spark):
    d = spark.range(1)
    a, b, n = F.lit("anna maria maria"), F.lit("maria anna"), F.lit("NAME")
    dice, fuzzy, never, half = d.select(T.token_dice(a, b), T.similar_texts(F.lit("jonathan smith"), F.lit("jonathan smyth"), n), T.similar_texts(F.lit("12345"), F.lit("12346"), F.lit("ZIP_CODE")), T.round_half_up(F.lit(1.005), 2)).first()
    assert dice == pytest.approx(2 * 3 / 5) and fuzzy and not never and half == 1.0
    assert unicodedata.normalize("NFC", ner.fold("Å")) == "a"
