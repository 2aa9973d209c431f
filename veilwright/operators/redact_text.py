"""Text redaction: entities are mapped to spans of regions, spans merged and replaced, results verified.

The mapping tries sources of evidence in a fixed order and stops at the first that hits, which
no set operation expresses; it runs as one row-local call per observation.  Span islands and
their replacement, which do have a relational form, are also offered natively.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.config import DEFAULT, OTHER_PLACEHOLDER, PLACEHOLDERS, SPECIFIC_PLACEHOLDERS, WEAK_PLACEHOLDERS, EngineConfig
from veilwright.functions.text import trim
from veilwright.operators.ner import fold

# ------------------------------------------------------------------------------------ native spans


def span_islands(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans (start, end, placeholder) with ``island`` (from 1 per key), ``island_start``, ``island_end``, ``island_placeholder``, ``covered``.

    Spans that strictly overlap form an island; touching ones do not.  Its placeholder is that of
    its first span, unless that is a weak one and a later span has a specific one.
    """
    order = [F.col("start"), F.col("end").desc(), *([F.col("det_ord")] if "det_ord" in spans.columns else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(F.coalesce(F.col("start") < reach, F.lit(False)), 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(w)).withColumn("rank", F.row_number().over(w)).drop("opens")
    inside = Window.partitionBy(*keys, "island")
    first = F.min_by("placeholder", "rank").over(inside)
    specific = F.min_by(F.when(F.col("placeholder").isin(*SPECIFIC_PLACEHOLDERS), F.col("placeholder")), F.when(F.col("placeholder").isin(*SPECIFIC_PLACEHOLDERS), F.col("rank"))).over(inside)
    return numbered.withColumns(
        {
            "island_start": F.min("start").over(inside),
            "island_end": F.max("end").over(inside),
            "island_placeholder": F.when(first.isin(*WEAK_PLACEHOLDERS), F.coalesce(specific, first)).otherwise(first),
            "covered": F.col("rank") > F.min("rank").over(inside),
        }
    ).drop("rank")


def apply_islands(texts: DataFrame, spans: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, the text with every island replaced, and how many were."""
    islands = span_islands(spans, *keys).where("not covered").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("island_start").alias("s"), F.col("island_end").alias("e"), F.col("island_placeholder").alias("p")))).alias("i"))
    joined = texts.select(*keys, F.col(text).alias("text")).join(islands, list(keys), "left")
    return joined.select(*keys, replaced("text", "i").alias("text"), F.coalesce(F.size("i"), F.lit(0)).alias("n_redactions"))


def replaced(text: str, islands: str) -> Column:
    """The text with sorted, disjoint islands (s, e, p) replaced; null islands change nothing."""
    pieces = f"transform({islands}, (x, k) -> concat(substring({text}, case when k = 0 then 1 else {islands}[k - 1].e + 1 end, x.s - case when k = 0 then 0 else {islands}[k - 1].e end), x.p))"
    return F.expr(f"case when coalesce(size({islands}), 0) <= 0 then {text} else concat(array_join({pieces}, ''), substring({text}, element_at({islands}, -1).e + 1)) end")


def row_islands_sql(spans: str) -> str:
    """SQL for the sorted islands (s, e, p) of an array of spans (s, e, p) in one row: a fold, no shuffle."""
    ordered = f"array_sort({spans}, (a, b) -> case when a.s <> b.s then a.s - b.s else b.e - a.e end)"
    weak, specific = (", ".join(repr(x) for x in xs) for xs in (WEAK_PLACEHOLDERS, SPECIFIC_PLACEHOLDERS))
    last = "element_at(a, -1)"
    name = f"case when {last}.p in ({weak}) and x.p in ({specific}) then x.p else {last}.p end"
    grown = f"concat(slice(a, 1, size(a) - 1), array(named_struct('s', {last}.s, 'e', greatest({last}.e, x.e), 'p', {name})))"
    return f"aggregate({ordered}, cast(array() as array<struct<s:int,e:int,p:string>>), (a, x) -> case when size(a) > 0 and x.s < element_at(a, greatest(1, size(a))).e then {grown} else concat(a, array(x)) end)"


# ------------------------------------------------------------------------------- mapping entities


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    placeholder: str
    provenance: str
    entity: int = -1
    kind: str = ""
    target: str = ""


#: How a span was found, for a text that occurs once and for one that occurs more often.
PROVENANCE = {
    "rampart_dom_region": ("rampart_dom_region_unique", "rampart_dom_region_all_occurrences"),
    "dom_text_regex": ("dom_text_regex_unique", "dom_text_regex_all_occurrences"),
    "dom_text": ("dom_text_unique_fallback", "dom_text_all_occurrences_fallback"),
    "ocr_spatial_grounded": ("ocr_spatial_grounded_unique", "ocr_spatial_grounded_all_occurrences"),
}


def placeholder_of(kind: str | None) -> str:
    return PLACEHOLDERS.get((kind or "").upper(), OTHER_PLACEHOLDER)


def _all(hay: str, needle: str, width: int) -> list[tuple[int, int]]:
    out, at = [], hay.find(needle)
    while at >= 0:
        out.append((at, at + width))
        at = hay.find(needle, at + width)
    return out


def occurrences(text: str, target: str) -> list[tuple[int, int]]:
    """Disjoint occurrences of a text: as written, else ignoring case, else ignoring accents where that keeps lengths."""
    target = (target or "").strip()
    if not text or not target:
        return []
    found = _all(text, target, len(target)) or _all(text.lower(), target.lower(), len(target))
    if not found:
        folded, needle = fold(text), fold(target)
        if needle and len(folded) == len(text):
            found = _all(folded, needle, len(needle))
    return found


def _plausible(cut: str, expected: str, strict: bool) -> bool:
    """Whether offsets point at the expected text: equal (also without accents), or one holds the other."""
    got, want = cut.strip().lower(), expected.strip().lower()
    if got == want or cut.lower() == want or fold(got) == fold(want):
        return True
    if strict or not got or not want:
        return False
    a, b = fold(got), fold(want)
    return got in want or want in got or (bool(a) and bool(b) and (a in b or b in a))


def _region_tag(reason: str | None) -> int | None:
    m = re.search(r":reg(\d+)", reason or "")
    return int(m[1]) if m else None


class Mapper:
    """Finds the spans of one entity in one region."""

    def __init__(self, region: dict, entity: dict, config: EngineConfig):
        self.text: str = region["text"]
        self.index, self.box = region["region_index"], region["bbox"]
        self.entity, self.config = entity, config
        self.target = (entity["text"] or "").strip()
        self.evidence: list[dict] = entity["evidence"] or []

    def spans(self) -> list[tuple[int, int, str]]:
        if not self.target:
            return []
        found: list[tuple[int, int, str]] = []
        tagged = [e for e in self.evidence if e["source"] == "RAMPART" and e["context_source"] == "DOM" and e["start"] is not None and e["end"] is not None]
        typed = [e for e in self.evidence if e["source"] == "DOM_TEXT"]
        for rows, exact, located in ((tagged, "rampart_dom_exact", "rampart_dom_region"), (typed, "dom_text_regex_exact", "dom_text_regex")):
            for e in rows:
                found += self._by_evidence(e, exact, located)
                if found and not self.config.strict:
                    return found
        if found:
            return found
        e = self.entity
        if any(x["source"] == "OCR" or x["context_source"] == "OCR" for x in [e, *self.evidence]):
            return self._by_place()
        if any(x["context_source"] == "DOM" or x["source"] == "DOM_TEXT" for x in [e, *self.evidence]):
            for text in dict.fromkeys([self.target, *((x["text"] or "").strip() for x in self.evidence)]):
                if hits := self._named(text, "dom_text"):
                    return hits
        return []

    def _named(self, text: str, label: str) -> list[tuple[int, int, str]]:
        found = occurrences(self.text, text)
        name = PROVENANCE[label][0 if len(found) == 1 else 1]
        return [(a, b, name) for a, b in found]

    def _by_evidence(self, e: dict, exact: str, located: str) -> list[tuple[int, int, str]]:
        tag = _region_tag(e["reason"])
        if tag is not None and self.index is not None and tag != self.index:
            return []
        wanted = e["text"] or self.target
        a, b = e["start"], e["end"]
        if a is not None and b is not None and 0 <= a < b <= len(self.text) and _plausible(self.text[a:b], wanted, self.config.strict):
            while a < b and self.text[a].isspace():
                a += 1
            while b > a and self.text[b - 1].isspace():
                b -= 1
            if a < b:
                return [(a, b, exact)]
        return self._named(wanted, located)

    def _by_place(self) -> list[tuple[int, int, str]]:
        p, q, slack = self.entity["bbox"], self.box, self.config.box_tolerance
        if p and q and p["x"] is not None and q["x"] is not None:
            w = min(p["x"] + (p["width"] or 0), q["x"] + (q["width"] or 0)) - max(p["x"], q["x"])
            h = min(p["y"] + (p["height"] or 0), q["y"] + (q["height"] or 0)) - max(p["y"], q["y"])
            if w < -slack or h < -slack:
                return []
        return self._named(self.target, "ocr_spatial_grounded") if self.target.lower() in self.text.lower() else []


class Needles:
    """What an entity may be found by: regions its evidence names, and its texts, plain and folded once."""

    def __init__(self, entity: dict):
        evidence = entity["evidence"] or []
        offsets = [_region_tag(x["reason"]) for x in evidence if x["start"] is not None and x["end"] is not None]
        self.everywhere, self.tags = None in offsets, set(offsets)
        texts = {t for t in ((entity["text"] or "").strip(), *((x["text"] or "").strip() for x in evidence)) if t}
        self.texts, self.lower, self.folded = texts, {t.lower() for t in texts}, {f for f in map(fold, texts) if f}

    def may_hit(self, index: int | None, text: str, lower: str, folded: str) -> bool:
        """False only where the mapping cannot find anything."""
        if self.everywhere or index is None or index in self.tags:
            return True
        return any(t in lower for t in self.lower) or any(t in text for t in self.texts) or any(t in folded for t in self.folded)


def merge(spans: list[Span]) -> list[tuple[int, int, str, list[Span]]]:
    """Islands of overlapping spans: start, end, placeholder, members in order."""
    islands: list[tuple[int, int, str, list[Span]]] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if islands and s.start < islands[-1][1]:
            a, b, name, members = islands[-1]
            if name in WEAK_PLACEHOLDERS and s.placeholder in SPECIFIC_PLACEHOLDERS:
                name = s.placeholder
            islands[-1] = (a, max(b, s.end), name, [*members, s])
        else:
            islands.append((s.start, s.end, s.placeholder, [s]))
    return islands


def rebuild(text: str, islands: list[tuple[int, int, str, list[Span]]]) -> str:
    out, at = [], 0
    for a, b, name, _ in islands:
        out += [text[at:a], name]
        at = b
    return "".join([*out, text[at:]])


def redact_text(text: str | None, entities: list[dict], config: EngineConfig = DEFAULT) -> tuple[str, int]:
    """A single text with the spans of entities replaced: document offsets that agree, else all occurrences."""
    text = text or ""
    spans: list[Span] = []
    for e in entities:
        target = (e["text"] or "").strip()
        own = [x for x in (e["evidence"] or [e]) if x["source"] == "RAMPART" and x["context_source"] == "DOM" and x["start"] is not None and x["end"] is not None]
        good = next((x for x in own if 0 <= x["start"] < x["end"] <= len(text) and text[x["start"] : x["end"]].strip().lower() == (x["text"] or target).lower()), None) if target else None
        found = [(good["start"], good["end"])] if good else occurrences(text, target)
        label = "dom_rampart_offset" if good else "unique_match" if len(found) == 1 else "all_occurrences_match"
        spans += [Span(a, b, placeholder_of(e["type"]), label) for a, b in found]
    islands = merge(spans)
    return rebuild(text, islands), len(islands)


def occurrence_counts(rows: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """key and ``n``, how often the target occurs in the text, ignoring case or accents if need be; null counts as empty."""
    kept = rows.select(key, text, target)

    def run(batches):
        for batch in batches:
            found = [len(occurrences(t or "", w or "")) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "n"])

    return kept.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n long")


def joined_texts(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """key, the trimmed non-blank texts in order joined by line ends (null if there is none), and ``n``, how many rows there were."""
    packed = rows.withColumn("__t", trim(F.col(text))).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t")))).alias("__x"), F.count(F.lit(1)).alias("n"))
    lines = F.filter(F.transform("__x", lambda x: x["t"]), lambda t: t != "")
    return packed.select(key, F.nullif(F.array_join(lines, "\n"), F.lit("")).alias("text"), "n")


# --------------------------------------------------------------------------------- whole observations

SUMMARY = "struct<required:int,mapped:int,applied:int,covered:int,unresolved:int,verification_failures:int>"
RESULT = (
    "sanitized_text string, n_regions int, total_redactions int, complete boolean, "
    f"summary {SUMMARY}, unredacted array<struct<fused_ord:int,type:string,reason:string>>, "
    "redactions array<struct<fused_ord:int,type:string,region_index:int,placeholder:string,provenance:string,covered:boolean,start:int,end:int>>, "
    "regions array<struct<region_index:int,text:string,redacted_count:int>>"
)

#: Reasons of entities that were not redacted.
NOT_FOUND, NOT_APPLIED, PERSISTS = "GENUINE_DOM_TEXT_SPAN_NOT_FOUND", "REDACTION_SPAN_NOT_APPLIED", "TEXT_PERSISTS_AT_REPLACEMENT_SPAN"


def needs_redaction(e: dict, matched: bool) -> bool:
    """Whether an entity with text has to appear redacted: it was matched, or comes from visible text and not only from an element."""
    sources = e["sources"] or []
    reason = e["reason"] or ""
    only_element = e["source"] == "DOM" or ("DOM" in sources and "DOM_TEXT" not in sources and e["context_source"] != "DOM")
    only_element = only_element or (not matched and (bool(e["element_id"]) or reason.startswith(("input[", "autocomplete", "metadata-"))))
    visible = e["context_source"] == "DOM" or (e["source"] == "DOM_TEXT" and not e["element_id"])
    visible = visible or any((x["context_source"] == "DOM" or x["source"] == "DOM_TEXT") and not x["element_id"] for x in e["evidence"] or [])
    return matched or (visible and not only_element)


def redact_page(regions: list[dict], entities: list[dict], config: EngineConfig = DEFAULT) -> dict:
    """The regions of one observation with entities replaced, and the account of it; without regions nothing is asked for."""
    entities = entities if regions else []
    needles = [Needles(e) for e in entities]
    shown, redactions = [], []
    failed: set[int] = set()
    direct: set[int] = set()
    covered: set[int] = set()
    mapped: set[int] = set()
    total = 0
    for region in regions:
        text = region["text"]
        if text is None:
            continue
        spans = []
        lower, folded = text.lower(), fold(text) if needles else ""
        for e, needle in zip(entities, needles):
            if not needle.may_hit(region["region_index"], text, lower, folded):
                continue
            for a, b, name in Mapper(region, e, config).spans():
                spans.append(Span(a, b, placeholder_of(e["type"]), name, e["fused_ord"], e["type"], (e["text"] or "").strip()))
        mapped |= {s.entity for s in spans}
        islands = merge(spans)
        for a, b, name, members in islands:
            lead = members[0]
            direct.add(lead.entity)
            stays = text[a:b] in name or (bool(lead.target) and lead.target in name)
            if stays:
                failed.add(lead.entity)
            covered |= {s.entity for s in members[1:]}
            for k, s in enumerate(members):
                if k or not stays:
                    redactions.append({"fused_ord": s.entity, "type": s.kind, "region_index": region["region_index"], "placeholder": name, "provenance": s.provenance, "covered": k > 0, "start": s.start, "end": s.end})
        total += len(islands)
        shown.append({"region_index": region["region_index"], "text": rebuild(text, islands), "redacted_count": len(islands)})
    summary = dict.fromkeys(("required", "mapped", "applied", "covered", "unresolved", "verification_failures"), 0)
    unredacted = []
    for e in entities:
        k = e["fused_ord"]
        done = k in direct or k in covered
        if not (e["text"] or "").strip() or not needs_redaction(e, done):
            continue
        summary["required"] += 1
        summary["mapped"] += k in mapped
        if not done or k in failed:
            summary["unresolved"] += 1
            summary["verification_failures"] += done
            unredacted.append({"fused_ord": k, "type": e["type"], "reason": PERSISTS if done else NOT_APPLIED if k in mapped else NOT_FOUND})
        else:
            summary["applied" if k in direct else "covered"] += 1
    lines = [r["text"].strip() for r in shown]
    return {
        "sanitized_text": "\n".join(x for x in lines if x),
        "n_regions": len(regions),
        "total_redactions": total,
        "complete": not unredacted,
        "summary": summary,
        "unredacted": unredacted,
        "redactions": redactions,
        "regions": shown,
    }


def redact_observations(observations: DataFrame, regions: DataFrame, fused: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row per observation with the fields of ``RESULT``; no regions give an empty, complete result."""
    from pyspark.sql.pandas.types import to_arrow_type

    r = regions.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("region_index", "text", "bbox"))).alias("r"))
    e = fused.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("fused_ord", "type", "source", "context_source", "element_id", "text", "reason", "bbox", "sources", "evidence"))).alias("e"))
    rows = observations.select("observation_id").join(r, "observation_id", "left").join(e, "observation_id", "left")
    kind = observations.sparkSession.createDataFrame([], f"observation_id string, {RESULT}").schema

    def run(batches):
        for batch in batches:
            out = [redact_page(r or [], e or [], config) for r, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([x[f.name] for x in out], to_arrow_type(f.dataType)) for f in kind.fields[1:]], kind.names)

    return rows.mapInArrow(run, kind)
