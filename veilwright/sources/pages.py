"""Page sources: elements and visible text of HTML, observation envelopes, plain text regions.

HTML has no layout.  What a browser measures is therefore a declared, synthetic layout: text
line i of a page lies at y = 20 i and is 16 high; a character is 8 wide.  Real geometry, where
it was captured, comes in through the tables of ``schemas`` instead.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from veilwright.config import HIDDEN_PARENTS
from veilwright.functions.text import SPACE, collapse, trim
from veilwright.schemas import ELEMENT_FIELDS, REGION_FIELDS

LINE, HEIGHT, ADVANCE = 20, 16, 8
PAGE_WIDTH, PAGE_HEIGHT = 1280, 720

#: Parsed pages are handed on once their sources have so many characters: as Python objects, regions and words take a hundred times that.
HELD_CHARACTERS = 1 << 18

_BOX = StructType([StructField(k, DoubleType()) for k in ("x", "y", "width", "height")])
_WORDS = ArrayType(StructType([StructField("text", StringType()), StructField("bbox", _BOX), StructField("confidence", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("button link textbox checkbox radio searchbox combobox".split())
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)|(?:width|height)\s*:\s*0(?:px)?\s*(?:;|$))", re.I)
_SPACES = re.compile(r"\s+")


class _Node:
    __slots__ = ("attributes", "children", "parent", "seen", "tag")

    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        own = "hidden" not in attributes and not _UNSEEN.search(attributes.get("style") or "") and not (tag == "input" and (attributes.get("type") or "").lower() == "hidden")
        self.seen = own and (parent is None or parent.seen)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in HIDDEN_PARENTS and node.seen:
                stack += reversed(node.children)
        return _SPACES.sub(" ", "".join(out)).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _parse(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _walk(root: _Node):
    """Nodes and text pieces in document order."""
    stack = [(root, None)]
    while stack:
        node, parent = stack.pop()
        yield node, parent
        if not isinstance(node, str):
            stack += [(c, node) for c in reversed(node.children)]


def _box(line: int, column: int, text: str) -> dict:
    return {"x": float(column * ADVANCE), "y": float(line * LINE), "width": float(max(1, len(text)) * ADVANCE), "height": float(HEIGHT)}


def text_regions(html: str | None) -> list[dict]:
    """The visible text nodes of a page, with their words."""
    out: list[dict] = []
    for node, parent in _walk(_parse(html)):
        if not isinstance(node, str) or parent.tag in HIDDEN_PARENTS or not parent.seen:
            continue
        text = _SPACES.sub(" ", node).strip()
        if text:
            line = len(out)
            words = [{"text": m[0], "bbox": _box(line, m.start(), m[0]), "confidence": None, "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", text)]
            out.append({"region_index": line, "element_id": None, "text": text, "bbox": _box(line, 0, text), "words": words, "visible": True, "in_viewport": line * LINE < PAGE_HEIGHT})
    return out


def _interactive(node: _Node) -> bool:
    a = node.attributes
    return node.tag in ("button", "input", "select", "textarea") or (node.tag == "a" and "href" in a) or a.get("role") in _ROLES or ("tabindex" in a and a["tabindex"] != "-1")


def _name(node: _Node, ids: dict[str, _Node], labels: dict[str, _Node]) -> str:
    """The first non-blank of aria-label, labelling elements, label, enclosing label, alt, title."""
    a = node.attributes
    around = node.parent
    while around is not None and around.tag != "label":
        around = around.parent
    referred = " ".join(ids[i].text() for i in a.get("aria-labelledby", "").split() if i in ids)
    candidates = (a.get("aria-label"), referred, labels[a["id"]].text() if a.get("id") in labels else "", around.text() if around is not None else "", a.get("alt"), a.get("title"))
    return next((c.strip()[:100] for c in candidates if c and c.strip()), "")


def _role(tag: str, kind: str | None) -> str:
    by_tag = {"a": "link", "button": "button", "textarea": "textbox", "select": "combobox"}
    by_type = {"checkbox": "checkbox", "radio": "radio", "submit": "button", "button": "button"}
    return by_type.get(kind or "", "textbox") if tag == "input" else by_tag.get(tag, "element")


def elements(html: str | None) -> list[dict]:
    """The rendered interactive elements of a page in document order; an input's value is never read into text."""
    root = _parse(html)
    nodes = [n for n, _ in _walk(root) if not isinstance(n, str)]
    ids, labels = {}, {}
    for n in nodes:
        ids.setdefault(n.attributes.get("id"), n)
        if n.tag == "label" and n.attributes.get("for"):
            labels.setdefault(n.attributes["for"], n)
    ids.pop(None, None)
    out: list[dict] = []
    for n in nodes:
        if not (_interactive(n) and n.seen):
            continue
        a, line = n.attributes, len(out)
        kind = a.get("type") or ("text" if n.tag == "input" else None)
        role = a.get("role") or _role(n.tag, kind)
        text = "" if n.tag in ("input", "textarea") else n.text()[:100]
        checked = None
        if kind in ("checkbox", "radio") or role in ("checkbox", "radio"):
            checked = "checked" in a if n.tag == "input" else a.get("aria-checked") == "true"
        options = [o for o, _ in _walk(n) if not isinstance(o, str) and o.tag == "option"] if n.tag == "select" else []
        chosen = next((o for o in options if "selected" in o.attributes), options[0] if options else None)
        plain = n.tag == "input" and kind not in ("button", "submit", "checkbox", "radio", "reset", "file", "image")
        value = a.get("value") if n.tag == "input" else n.text() if n.tag == "textarea" else ""
        out.append(
            {
                "ord": line,
                "element_id": f"e{line + 1}",
                "tag": n.tag,
                "type": kind,
                "name": a.get("name") or None,
                "role": role,
                "accessible_name": _name(n, ids, labels),
                "text": text,
                "placeholder": a.get("placeholder") or None,
                "autocomplete": a.get("autocomplete") or None,
                "has_value": bool(value),
                "enabled": "disabled" not in a,
                "editable": n.tag == "textarea" or plain or a.get("contenteditable", "false") in ("", "true"),
                "checked": checked,
                "selected": chosen.text() if chosen is not None else None,
                "visible": True,
                "in_viewport": line * LINE < PAGE_HEIGHT,
                "bbox": _box(line, 0, text or "x" * 20),
            }
        )
    return out


def _exploded(pages: DataFrame, key: str, html: str, fields: str, parse) -> DataFrame:
    rows = pages.select(F.col(key).cast("string").alias("observation_id"), F.col(html).alias("html"))
    schema = f"observation_id string, rows array<struct<{fields}>>"
    empty = pages.sparkSession.createDataFrame([], schema)
    kind = pa.schema([pa.field("observation_id", pa.string())])
    from pyspark.sql.pandas.types import to_arrow_type

    row_type = to_arrow_type(empty.schema["rows"].dataType)

    def run(batches):
        for batch in batches:
            begin, held, parsed = 0, 0, []
            for k, page in enumerate(batch.column(1)):
                source = page.as_py()
                parsed.append(parse(source))
                held += len(source or "")
                if held >= HELD_CHARACTERS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(parsed)), pa.array(parsed, row_type)], [kind[0].name, "rows"])
                    begin, held, parsed = k + 1, 0, []

    return rows.mapInArrow(run, schema).select("observation_id", F.inline("rows"))


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per rendered interactive element of each page."""
    return _exploded(pages, key, html, ELEMENT_FIELDS, elements)


def page_regions(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per visible text node of each page, with word boxes."""
    return _exploded(pages, key, html, REGION_FIELDS, text_regions)


def page_observations(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One envelope per page: address, viewport of the declared layout, canvas of twice its size."""
    return pages.select(
        F.col(key).cast("string").alias("observation_id"),
        F.col(url).alias("url"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.expr(f"named_struct('width', {PAGE_WIDTH}D, 'height', {PAGE_HEIGHT}D, 'scroll_x', 0D, 'scroll_y', 0D, 'dpr', 1D)").alias("viewport"),
        F.expr(f"named_struct('width', {2 * PAGE_WIDTH}, 'height', {2 * PAGE_HEIGHT})").alias("canvas"),
        F.lit(1.0).alias("dpr"),
        F.lit("").alias("goal"),
        F.lit(None).cast("array<string>").alias("available_actions"),
    )


def line_regions(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines of plain texts as regions, in the declared layout."""
    lines = texts.select(F.col(key).cast("string").alias("observation_id"), F.posexplode(F.split(F.col(text), "\n")).alias("region_index", "raw"))
    shown = lines.where(F.col("raw").rlike(f"[^{SPACE}]")).select("observation_id", "region_index", collapse(F.col("raw")).alias("text"))
    box = f"named_struct('x', 0D, 'y', {LINE}D * region_index, 'width', {ADVANCE}D * length(text), 'height', {HEIGHT}D)"
    return shown.select("observation_id", "region_index", F.lit(None).cast("string").alias("element_id"), "text", F.expr(box).alias("bbox"), words_with_geometry().alias("words"), F.lit(True).alias("visible"), F.expr(f"region_index * {LINE} < {PAGE_HEIGHT}").alias("in_viewport"))


@F.arrow_udf(_WORDS)
def _placed_words(texts: pa.Array, lines: pa.Array) -> pa.Array:
    """Words of collapsed texts with offsets and boxes, by whole columns."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    reach = np.cumsum(lengths + 1) - (lengths + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = (reach - reach[offsets[owner]]).astype(np.int32) if len(words) else np.zeros(0, np.int32)
    top = lines.to_numpy(zero_copy_only=False)[owner].astype(np.float64) * LINE
    box = pa.StructArray.from_arrays([pa.array(start * float(ADVANCE)), pa.array(top), pa.array(lengths * float(ADVANCE)), pa.array(np.full(len(words), float(HEIGHT)))], ["x", "y", "width", "height"])
    end = (start + lengths).astype(np.int32)
    word = pa.StructArray.from_arrays([words, box, pa.nulls(len(words), pa.float64()), pa.array(start), pa.array(end)], ["text", "bbox", "confidence", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), word)


def words_with_geometry() -> Column:
    """The words of ``text`` (already collapsed) with offsets and boxes of the declared layout at ``region_index``."""
    return _placed_words("text", "region_index")


# ------------------------------------------------------------------- the same rules over columns


def rendered(display: Column, visibility: Column, opacity: Column, width: Column, height: Column) -> Column:
    """Whether an element is drawn; opacity as CSS text or number, null counts as drawn."""
    see_through = F.coalesce(opacity.cast("string").try_cast("double"), F.lit(1.0)) == 0
    return F.coalesce((F.coalesce(display, F.lit("")) != "none") & (F.coalesce(visibility, F.lit("")) != "hidden") & ~see_through & (width > 0) & (height > 0), F.lit(False))


def in_viewport(box: Column, viewport: Column) -> Column:
    return F.coalesce((box["y"] + box["height"] > 0) & (box["y"] < viewport["height"]) & (box["x"] + box["width"] > 0) & (box["x"] < viewport["width"]), F.lit(False))


def accessible_name(*candidates: Column) -> Column:
    """The first non-blank candidate, trimmed, 100 characters at most; else empty."""
    return F.coalesce(*[F.substring(F.nullif(trim(c), F.lit("")), 1, 100) for c in candidates], F.lit(""))


def display_text(tag: Column, inner: Column) -> Column:
    return F.when(tag.isin("input", "textarea"), "").otherwise(F.coalesce(F.substring(collapse(inner), 1, 100), F.lit("")))


def implicit_role(tag: Column, kind: Column) -> Column:
    typed = F.when(kind.isin("checkbox", "radio"), kind).when(kind.isin("submit", "button"), "button").otherwise("textbox")
    return F.when(tag == "a", "link").when(tag == "button", "button").when(tag == "textarea", "textbox").when(tag == "select", "combobox").when(tag == "input", typed).otherwise("element")


def default_type(tag: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.when(tag == "input", "text"))


def editable(tag: Column, kind: Column, content_editable: Column) -> Column:
    plain = (tag == "input") & ~F.coalesce(kind, F.lit("text")).isin("button", "submit", "checkbox", "radio", "reset", "file", "image")
    return (tag == "textarea") | plain | F.coalesce(content_editable, F.lit(False))


def has_value(tag: Column, value: Column) -> Column:
    return tag.isin("input", "textarea") & (F.length(F.coalesce(value, F.lit(""))) > 0)
