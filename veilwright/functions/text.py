"""Text functions as native expressions: detection patterns, offsets, normal forms, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.config import COMPACT_TYPES, NEVER_FUZZY, OTHER_PLACEHOLDER, PLACEHOLDERS, PRIORITY

#: White space as browsers see it; Java's ``\s`` and SQL's trim know less of it.
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word boundary over ASCII word characters only.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Patterns of the text detector.
EMAIL = EDGE + r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}" + EDGE
PHONE = rf"(?:\+?91[{SPACE}-]?)?[6-9][0-9]{{4}}[{SPACE}-]?[0-9]{{5}}" + EDGE
STRICT_PHONE = r"(?<![A-Za-z0-9_])" + PHONE
CARD = EDGE + r"(?:[0-9][ -]*?){13,19}" + EDGE
# Keyword patterns over form metadata, and others.
PASSWORD_WORDS = EDGE + r"(?:password|passcode|secret|pin)" + EDGE
CARD_WORDS = EDGE + r"(?:card[-_]?number|credit[-_]?card|cc[-_]?num|cardnum)" + EDGE
PUNCTUATION = r"^[.,@_\-/:;?!]+$"
VALID_EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"


SPAN = "struct<type:string,text:string,confidence:double,reason:string,start:int,end:int>"


def literal(pattern: str) -> str:
    """A pattern or text as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trim(c: Column) -> Column:
    """Without outer white space, in the browser's sense."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column, by: str = " ") -> Column:
    """Runs of white space replaced by ``by``."""
    return F.regexp_replace(c, rf"[{SPACE}]+", by)


def collapse(c: Column) -> Column:
    """Trimmed, with single spaces; texts that only have single ordinary spaces skip the replacement."""
    odd = c.rlike(rf"[{SPACE.replace(' ', '', 1)}]") | F.contains(c, F.lit("  "))
    return F.when(odd, squeeze(trim(c))).otherwise(F.trim(c))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Half towards plus infinity, without decimal rounding of the binary value."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k if digits else F.floor(c + 0.5).cast("double")


def matches_sql(text: str, pattern: str) -> str:
    """SQL for array<struct<text,start,end>> of the matches of a pattern in a SQL text expression; null text, no matches."""
    p = literal(pattern)
    empty = "cast(array() as array<struct<text:string,start:int,end:int>>)"
    fold = (
        f"aggregate(s.m, named_struct('i', 0, 'p', 0, 'o', {empty}), (a, m) -> named_struct('i', a.i + 1, 'p', a.p + length(s.g[a.i]) + length(m),"
        " 'o', concat(a.o, array(named_struct('text', m, 'start', a.p + length(s.g[a.i]), 'end', a.p + length(s.g[a.i]) + length(m))))), a -> a.o)"
    )
    bound = f"transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))), s -> {fold})[0]"
    return f"coalesce({bound}, {empty})"


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn_sql(digits: str) -> str:
    return f"(length({digits}) between 13 and 19 and luhn_check({digits}))"


def detect_sql(text: str, strict: bool = False) -> str:
    """SQL for the detections in a text: all emails, then phones, then cards, each with offsets."""
    phone = digits_sql("m.text")
    # a card match may end in separators: they belong to the match but not to the value
    cut = "regexp_replace(m.text, ' +$', '')"

    def rows(kind: str, pattern: str, where: str, value: str, confidence: float, reason: str, guard: str) -> str:
        made = f"named_struct('type', '{kind}', 'text', {value}, 'confidence', {confidence}D, 'reason', '{reason}', 'start', m.start, 'end', m.start + length({value}))"
        found = f"transform(filter({matches_sql(text, pattern)}, m -> {where}), m -> {made})"
        return f"case when {guard} then {found} else cast(array() as array<{SPAN}>) end"  # the guard is cheap and rarely passes

    return (
        "concat("
        + rows("EMAIL", EMAIL, "true", "m.text", 0.99, "email-regex", f"contains({text}, '@')")
        + ", "
        + rows("PHONE", STRICT_PHONE if strict else PHONE, f"length({phone}) = 10 or (length({phone}) = 12 and startswith({phone}, '91'))", "m.text", 0.95, "indian-phone-regex", f"{text} rlike '[6-9][0-9]{{4}}'")
        + ", "
        + rows("CARD", CARD, luhn_sql(digits_sql("m.text")), cut, 0.99, "luhn-card-regex", f"{text} rlike '([0-9][ -]*){{13}}'")
        + ")"
    )


def detect(text: str, strict: bool = False) -> Column:
    """The detections in the column of that name."""
    return F.expr(detect_sql(f"`{text}`", strict))


def normalize_text(text: Column, kind: Column) -> Column:
    """The form in which texts of a type are compared; null and blank give the empty string."""
    t = trim(text)
    return F.coalesce(
        F.when(kind == "EMAIL", squeeze(F.lower(t), ""))
        .when(kind == "PHONE", F.regexp_replace(t, "[^0-9]", ""))
        .when(kind.isin(*COMPACT_TYPES), F.regexp_replace(F.lower(t), rf"[{SPACE}\-_]", ""))
        .otherwise(squeeze(F.lower(t))),
        F.lit(""),
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_dice(a: Column, b: Column) -> Column:
    """Twice the tokens of a that b has (repeats counted), over both token counts; 0 unless both have two tokens."""
    x, y = (F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "") for c in (a, b))
    shared = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return F.when((F.size(x) > 1) & (F.size(y) > 1), 2.0 * shared / (F.size(x) + F.size(y))).otherwise(0.0)


def similar_texts(a: Column, b: Column, kind: Column) -> Column:
    """Whether normalised texts of a type that allows it are nearly equal."""
    near = (levenshtein_similarity(a, b) >= 0.85) | (token_dice(a, b) >= 0.8)
    return ~kind.isin(*NEVER_FUZZY) & (a != "") & (b != "") & near


def source_key(source: Column, context: Column) -> Column:
    ner = F.when(context == "DOM", "RAMPART_DOM").otherwise("RAMPART_OCR")
    return F.when(source.isin("DOM", "DOM_TEXT", "OCR"), source).when(source == "RAMPART", ner).otherwise("UNKNOWN")


def source_priority(source: Column, context: Column) -> Column:
    key = source_key(source, context)
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def placeholder(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(kind)), F.lit(OTHER_PLACEHOLDER))


def text_quality(text: Column, kind: Column, source: Column, context: Column, confidence: Column, ocr: Column) -> Column:
    """The score by which the text of a merged entity is chosen; null for blank texts."""
    t = trim(text)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    compact = F.regexp_replace(t, rf"[{SPACE}\-]", "")
    by_source = F.when(source == "DOM_TEXT", 100).when((source == "RAMPART") & (context == "DOM"), 80).when(source == "OCR", 60).when((source == "RAMPART") & (context == "OCR"), 40).otherwise(20)
    by_ocr = F.when(ocr < 0.5, -30).when(ocr < 0.7, -15).when(ocr >= 0.9, 10).otherwise(0)
    email = F.when(t.rlike(VALID_EMAIL), 50).otherwise(-30) + F.when(t.rlike(f"[{SPACE}]"), -20).otherwise(0)
    phone = F.when(digits.between(10, 15), 40).otherwise(-20) + F.when(t.rlike("[a-zA-Z]"), -40).otherwise(0)
    card = F.when(digits.between(13, 19), 40).otherwise(0) + F.when(t.rlike(rf"[^0-9{SPACE}\-]"), -30).otherwise(0)
    zip_code = F.when(compact.rlike("^[0-9]{5}([0-9]{4})?$") | compact.rlike("(?i)^[A-Z0-9]{3,10}$"), 30).otherwise(0)
    by_type = F.when(kind == "EMAIL", email).when(kind == "PHONE", phone).when(kind == "CARD", card).when(kind == "ZIP_CODE", zip_code).otherwise(0)
    dirty = F.when(t.rlike(r"[\x00-\x1F\x7F]"), -25).otherwise(0)
    score = by_source + F.coalesce(by_ocr, F.lit(0)) + by_type + F.coalesce(confidence, F.lit(0.5)) * 15 + dirty
    return F.when(t != "", score.cast("double"))


def rescale_confidence(c: Column) -> Column:
    """Percentages to fractions; null counts as 0."""
    x = F.coalesce(c, F.lit(0.0))
    return F.when(x > 1, x / 100).otherwise(x)


def region_of(region_index: Column, reason: Column) -> Column:
    """The region of a detection: its field, or the ``:reg`` tag of its reason."""
    tag = F.regexp_extract(reason, r":reg([0-9]+)", 1)
    return F.coalesce(region_index, F.when(tag != "", tag.cast("int")))
