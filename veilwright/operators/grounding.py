"""From character spans to boxes: word intervals, overlap, union.  All native, one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.functions.geometry import union_sql
from veilwright.functions.text import SPACE, literal
from veilwright.schemas import BOX

_ROWS = f"array<struct<s:int,e:int,b:{BOX}>>"


def intervals_sql(words: str, text: str, honour_offsets: bool) -> str:
    """SQL for the (s, e, b) interval of each non-blank word: given offsets, else found forward, else in sequence."""
    clean = f"filter(transform({words}, w -> named_struct('t', lower(regexp_replace(w.text, {literal(f'^[{SPACE}]+|[{SPACE}]+$')}, '')), 's', w.start, 'e', w.end, 'b', w.bbox)), w -> w.t <> '')"
    found = f"case when coalesce({text}, '') = '' then -1 else locate(w.t, lower({text}), a.c + 1) - 1 end"
    add = "concat(a.o, array(named_struct('s', {s}, 'e', {e}, 'b', w.b)))"
    at = "transform(array({found}), p -> case when p >= 0 then named_struct('c', p + length(w.t), 'o', {hit}) else named_struct('c', a.c + length(w.t) + 1, 'o', {miss}) end)[0]".format(found=found, hit=add.format(s="p", e="p + length(w.t)"), miss=add.format(s="a.c", e="a.c + length(w.t)"))
    step = f"case when w.s is not null and w.e is not null and coalesce({text}, '') <> '' then named_struct('c', a.c, 'o', {add.format(s='w.s', e='w.e')}) else {at} end" if honour_offsets else at
    fold = f"aggregate(x, named_struct('c', 0, 'o', cast(array() as {_ROWS})), (a, w) -> {step}, a -> a.o)"
    if honour_offsets:  # where every word has its offsets there is no cursor to carry
        fold = f"case when coalesce({text}, '') <> '' and forall(x, w -> w.s is not null and w.e is not null) then transform(x, w -> named_struct('s', w.s, 'e', w.e, 'b', w.b)) else {fold} end"
    return f"transform(array({clean}), x -> {fold})[0]"


def span_box_sql(words: str, start: str, end: str, text: str, honour_offsets: bool) -> str:
    """SQL for the union of the boxes of the words that a span overlaps; null without words, for bad spans and for no overlap."""
    hit = f"filter({intervals_sql(words, text, honour_offsets)}, i -> greatest({start}, i.s) < least({end}, i.e) and i.b is not null)"
    return f"case when {start} >= 0 and {end} > {start} then {union_sql(f'transform({hit}, i -> i.b)')} end"


def ground(rows: DataFrame, dom_words: str | None = "dom_words", ocr_words: str | None = "ocr_words", text: str = "source_text") -> DataFrame:
    """``rows`` with ``bbox`` replaced by the box of (start, end): from document words, else recognised words, else null."""
    options = []
    if dom_words:
        options.append(span_box_sql(dom_words, "start", "end", text, True))
    if ocr_words:
        options.append(span_box_sql(ocr_words, "start", "end", text, False))
    return rows.withColumn("bbox", F.expr(f"cast(coalesce({', '.join(options)}) as {BOX})"))


def overlapping_confidence_sql(words: str, box: str) -> str:
    """SQL for the mean confidence (two decimals) of the words whose boxes overlap a box; null where none does."""
    hit = f"filter({words}, w -> greatest({box}.x, w.bbox.x) < least({box}.x + {box}.width, w.bbox.x + w.bbox.width) and greatest({box}.y, w.bbox.y) < least({box}.y + {box}.height, w.bbox.y + w.bbox.height))"
    part = "transform(s, w -> case when coalesce(w.confidence, 1D) > 1 then w.confidence / 100 else coalesce(w.confidence, 1D) end)"
    mean = f"aggregate({part}, 0D, (a, c) -> a + c) / size(s)"
    return f"transform(array({hit}), s -> case when size(s) > 0 then floor({mean} * 100 + 0.5D) / 100 end)[0]"
