"""Tagged tokens to detections: tags, grouping, alignment with the text, confidence, grounding.

The tagger is a plug-in: a factory that gives a function from a text to token rows.  Workers make
it once.  ``dictionary_tagger`` is a stand-in over word lists, not a trained model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from veilwright.functions.text import PUNCTUATION
from veilwright.operators.detect import as_detections
from veilwright.operators.grounding import ground, overlapping_confidence_sql
from veilwright.schemas import TOKENS, WORD

_SPANS = ArrayType(StructType().add("type", StringType()).add("text", StringType()).add("confidence", DoubleType()).add("reason", StringType()).add("start", IntegerType()).add("end", IntegerType()))
_MARKS = re.compile("[\u0300-\u036f]")
_PUNCTUATION = re.compile(PUNCTUATION)


def fold(text: str) -> str:
    """Lower case without combining marks."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


@F.arrow_udf(StringType())
def folded(texts: pa.Array) -> pa.Array:
    """``fold`` over a column; null stays null."""
    return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())


# ------------------------------------------------------------------------------------- native part


def tag_prefix(entity: Column) -> Column:
    e = F.coalesce(entity, F.lit(""))
    return F.when(e.isin("", "O"), "O").when(F.startswith(e, F.lit("I-")), "I").otherwise("B")


def tag_type(entity: Column) -> Column:
    e = F.coalesce(entity, F.lit(""))
    return F.when(e.isin("", "O"), "O").otherwise(F.regexp_replace(e, "^[BI]-", ""))


def group_tokens(tokens: DataFrame, *keys: str) -> DataFrame:
    """Entity tokens with ``kind`` and ``group_no`` (from 1), by looking one token back; other tokens go.

    A token continues its predecessor if the type is the same and it is an inside tag, or a word
    piece, or directly follows within an e-mail, phone, URL, or next to punctuation.
    """
    w = Window.partitionBy(*keys).orderBy("tok_ord")
    t = tokens.withColumn("kind", tag_type(F.col("entity"))).withColumn("prefix", tag_prefix(F.col("entity")))
    before = {c: F.lag(c).over(w) for c in ("kind", "word", "tok_index")}
    close = F.col("kind").isin("EMAIL", "PHONE", "URL") | F.col("word").rlike(PUNCTUATION) | before["word"].rlike(PUNCTUATION)
    joins = (before["kind"] == F.col("kind")) & ((F.col("prefix") == "I") | F.startswith(F.col("word"), F.lit("##")) | ((F.col("tok_index") == before["tok_index"] + 1) & close))
    flagged = t.withColumn("opens", F.when((F.col("kind") != "O") & ~F.coalesce(joins, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn("group_no", F.sum("opens").over(w)).where("kind <> 'O'").drop("prefix", "opens")


def group_spans(grouped: DataFrame, *keys: str) -> DataFrame:
    """One row per group: kind, confidence (the least score, four decimals), its tokens in order, and text as joined tokens."""
    token = F.struct("tok_ord", "word", "start", "end")
    out = grouped.groupBy(*keys, "group_no").agg(F.first("kind").alias("kind"), F.min(F.coalesce("score", F.lit(0.0))).alias("least"), F.array_sort(F.collect_list(token)).alias("tokens"))
    return out.select(*keys, "group_no", "kind", (F.floor(F.col("least") * 10000 + 0.5) / 10000).alias("confidence"), "tokens", joined_tokens("tokens").alias("joined"))


def joined_tokens(column: str) -> Column:
    """The tokens with spaces, but none before word pieces and punctuation."""
    words = F.transform(F.col(column), lambda t: t["word"])

    def step(a, w):
        clean = F.regexp_replace(w, "^##", "")
        glued = (a == "") | F.startswith(w, F.lit("##")) | clean.rlike(PUNCTUATION)
        return F.concat(a, F.when(glued, "").otherwise(" "), clean)

    return F.aggregate(words, F.lit(""), step)


# ------------------------------------------------------------------------------ order-bound part


def align(text: str, groups: list[dict]) -> list[tuple[int, int] | None]:
    """The span of each group: token offsets if valid, else its words found one after another from where the last group ended."""
    out: list[tuple[int, int] | None] = []
    cursor = 0
    low = text.lower() if text else ""
    folded = fold(text) if text else ""
    same = len(folded) == len(text or "")
    hay = folded if same else low
    for group in groups:
        tokens = group["tokens"]
        a, b = (tokens[0]["start"], tokens[-1]["end"]) if tokens else (None, None)
        if text and a is not None and b is not None and 0 <= a < b <= len(text):
            out.append((a, b))
            cursor = b
            continue
        span = _find(hay, [_needle(t["word"], same) for t in tokens], cursor) if text else None
        out.append(span)
        cursor = span[1] if span else cursor
    return out


def _needle(word: str | None, folded: bool) -> str:
    clean = (word or "").removeprefix("##")
    return fold(clean) if folded else clean.lower()


def _find(hay: str, needles: list[str], at: int) -> tuple[int, int] | None:
    first = None
    for needle in filter(None, needles):
        here = hay.find(needle, at)
        if here < 0:
            here = hay.find(needle)
        if here < 0:
            return None
        first = here if first is None else first
        at = here + len(needle)
    return (first, at) if first is not None and first < at else None


def group_in_python(tokens: list[dict]) -> list[dict]:
    """The same grouping for one text's tokens, for taggers whose tokens are at hand in the worker."""
    groups: list[dict] = []
    last = None
    for t in tokens:
        entity = t["entity"] or "O"
        kind = entity[2:] if entity[:2] in ("B-", "I-") else entity
        if kind == "O":
            last = None
            continue
        follows = last is not None and groups[-1]["kind"] == kind
        if follows:
            near = kind in ("EMAIL", "PHONE", "URL") or _PUNCTUATION.match(t["word"]) or _PUNCTUATION.match(last["word"])
            follows = entity.startswith("I-") or t["word"].startswith("##") or (t["index"] == last["index"] + 1 and bool(near))
        if not follows:
            groups.append({"kind": kind, "tokens": []})
        groups[-1]["tokens"].append(t)
        last = t
    return groups


def entity_spans(text: str, tokens: list[dict]) -> list[dict]:
    """Detections of one tagged text: type, text, confidence, reason, start, end."""
    groups = group_in_python(tokens)
    out = []
    for group, span in zip(groups, align(text, groups)):
        least = min((t["score"] if t["score"] is not None else 0.0) for t in group["tokens"])
        joined = ""
        for t in group["tokens"]:
            clean = t["word"].removeprefix("##")
            glued = not joined or t["word"].startswith("##") or _PUNCTUATION.match(clean)
            joined += clean if glued else " " + clean
        out.append({"type": group["kind"], "text": text[span[0] : span[1]] if span else joined, "confidence": int(least * 10000 + 0.5) / 10000, "reason": f"rampart-ner:{group['kind']}", "start": span[0] if span else None, "end": span[1] if span else None})
    return out


# --------------------------------------------------------------------------------------- taggers

Tagger = Callable[[str], list[dict]]

#: Small word lists of the stand-in tagger.
GIVEN = frozenset("alice anna carlos david emma hans james john maria marie mary paul peter priya rahul robert sarah".split())
FAMILY = frozenset("brown garcia johnson jones kumar martin miller muller patel sharma singh smith walker williams".split())
STREETS = frozenset("avenue boulevard drive lane rd road street strasse way".split())
CITIES = frozenset("berlin boston chicago delhi london madrid mumbai paris pune springfield".split())


def dictionary_tagger() -> Tagger:
    """A stand-in: names and cities from lists, house numbers before a street name.  Not a trained model."""

    def tag(text: str) -> list[dict]:
        words = list(re.finditer(r"\w+|[^\w\s]", text))
        kinds = [None] * len(words)
        for k, m in enumerate(words):
            w = m[0].lower()
            kinds[k] = "GIVEN_NAME" if w in GIVEN else "SURNAME" if w in FAMILY else "CITY" if w in CITIES else None
            if w in STREETS and k >= 2 and words[k - 2][0].isdigit():
                kinds[k - 2 : k + 1] = ["BUILDING_NUMBER", "STREET_NAME", "STREET_NAME"]
        return [
            {"entity": f"{'I' if k and kinds[k - 1] == kind and kind == 'STREET_NAME' else 'B'}-{kind}", "score": 0.9, "index": k, "word": m[0], "start": m.start(), "end": m.end()}
            for k, (m, kind) in enumerate(zip(words, kinds))
            if kind
        ]

    return tag


@lru_cache(maxsize=8)
def _loaded(factory: Callable[[], Tagger]) -> Tagger:
    """One tagger per worker process, made on first use."""
    return factory()


def token_rows(items: DataFrame, factory: Callable[[], Tagger] = dictionary_tagger) -> DataFrame:
    """The raw tokens of ``items`` (observation_id, context_source, item, text) as a token table."""
    keys = ["observation_id", "context_source", "item"]

    def run(batches):
        tagger = _loaded(factory)
        for batch in batches:
            rows = []
            for o, c, i, text in zip(*(col.to_pylist() for col in batch.columns)):
                rows += [(o, c, i, k, t["entity"], t["score"], t["index"], t["word"], t.get("start"), t.get("end")) for k, t in enumerate(tagger(text or ""))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            names = [*keys, "tok_ord", "entity", "score", "tok_index", "word", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return items.select(*keys, "text").mapInArrow(run, TOKENS)


def tagged_spans(items: DataFrame, factory: Callable[[], Tagger]) -> DataFrame:
    """``items`` with ``spans``: the detections of each text; a text on which the tagger fails has none.

    Only the texts go to the workers; words and boxes stay where they are.
    """

    @F.arrow_udf(_SPANS)
    def tag(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        tagger, out = _loaded(factory), []
        for text in texts.to_pylist():
            try:
                out.append(entity_spans(text, tagger(text)) if text else [])
            except Exception:  # one text must not stop the others
                out.append([])
        return pa.array(out, to_arrow_type(_SPANS))

    return items.withColumn("spans", tag("text"))


def detect_dom(regions: DataFrame, factory: Callable[[], Tagger]) -> DataFrame:
    """Tagged entities of visible text regions, grounded on their words, tagged with their region."""
    rows = tagged_spans(regions.select("observation_id", "region_index", "text", F.col("words").alias("dom_words")), factory)
    hits = rows.select("observation_id", "region_index", F.col("text").alias("source_text"), "dom_words", F.posexplode("spans").alias("k", "d")).select("*", "d.*").drop("d")
    found = ground(hits, "dom_words", None).withColumns({"source": F.lit("RAMPART"), "context_source": F.lit("DOM"), "reason": F.concat("reason", F.lit(":reg"), F.col("region_index"))})
    return as_detections(found, "region_index", "k")


def detect_lines(lines: DataFrame, factory: Callable[[], Tagger]) -> DataFrame:
    """Tagged entities of recognised lines, grounded on their words, with those words' mean confidence."""
    rows = tagged_spans(lines.select("observation_id", "line_ord", "text", F.col("words").alias("ocr_words")), factory)
    hits = rows.select("observation_id", "line_ord", F.col("text").alias("source_text"), "ocr_words", F.posexplode("spans").alias("k", "d")).select("*", "d.*").drop("d")
    found = ground(hits, None, "ocr_words").withColumns({"source": F.lit("RAMPART"), "context_source": F.lit("OCR")})
    return as_detections(found.withColumn("ocr_confidence", F.expr(overlapping_confidence_sql("ocr_words", "bbox"))), "line_ord", "k")


def detect_items(items: DataFrame, factory: Callable[[], Tagger]) -> DataFrame:
    """Tagged entities of given texts (observation_id, item, text, dom_words, ocr_words, context_source), which replace the other two."""
    rows = tagged_spans(items.select("observation_id", "item", "text", F.col("dom_words").cast(f"array<{WORD}>").alias("dom_words"), F.col("ocr_words").cast(f"array<{WORD}>").alias("ocr_words"), "context_source"), factory)
    context = F.coalesce("context_source", F.when(F.col("dom_words").isNotNull(), "DOM"), F.when(F.col("ocr_words").isNotNull(), "OCR"), F.lit("CONTEXTUAL"))
    hits = rows.withColumn("context_source", context).select("observation_id", "item", F.col("text").alias("source_text"), "dom_words", "ocr_words", "context_source", F.posexplode("spans").alias("k", "d")).select("*", "d.*").drop("d")
    return as_detections(ground(hits).withColumn("source", F.lit("RAMPART")), "item", "k")
