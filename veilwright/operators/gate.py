"""The egress gate: five checks, fail closed, and an allowlisted outbound record.  Native."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.config import ACTIONS, FORBIDDEN_KEYS
from veilwright.functions.text import trim
from veilwright.functions.url import sanitize_url

CHECKS = ("sanitized_dom_present", "sanitized_screenshot_present", "text_redaction_complete", "visual_redaction_complete", "outbound_schema_valid")
ROWS = (
    "observation_id string, url string, goal string, available_actions array<string>, canvas struct<width:int,height:int>, sanitized_text string, n_regions int, n_fused int, "
    "text_complete boolean, n_unredacted int, success boolean, data_url string, has_canvas boolean, visual_complete boolean, n_unmasked int"
)
_FORBIDDEN = frozenset(k.lower() for k in FORBIDDEN_KEYS)


def forbidden_fields(kind: T.DataType) -> list[str]:
    """Names of a schema, at any depth, that equal a forbidden key whatever their case."""
    out: list[str] = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            out += ([f.name] if f.name.lower() in _FORBIDDEN else []) + forbidden_fields(f.dataType)
    elif isinstance(kind, T.ArrayType):
        out += forbidden_fields(kind.elementType)
    elif isinstance(kind, T.MapType):
        out += forbidden_fields(kind.valueType)
    return out


def holds_forbidden_key(value) -> bool:
    """Whether a parsed JSON value has a forbidden key at any depth."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if any(k.lower() in _FORBIDDEN for k in x):
                return True
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return False


@F.pandas_udf(T.BooleanType())
def json_holds_forbidden_key(texts: pd.Series) -> pd.Series:
    """For JSON texts; broken or null JSON counts as holding one."""

    def check(text: str | None) -> bool:
        try:
            return holds_forbidden_key(json.loads(text))
        except (TypeError, ValueError):
            return True

    return texts.map(check).astype(bool)


def _first(*pairs: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds (null counts as holding), else null."""
    out = None
    for failed, reason in pairs:
        failed = F.coalesce(failed, F.lit(True))
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out


def gate(rows: DataFrame) -> DataFrame:
    """Verdicts: observation_id, allowed, checks, reasons, outbound.

    ``rows``: observation_id, url, goal, available_actions, canvas, sanitized_text, n_regions,
    n_fused, text_complete, n_unredacted, success, data_url, has_canvas, visual_complete,
    n_unmasked.  Null metadata fails its check.  A blocked observation has a null outbound record.
    """
    c = F.col
    screen = F.coalesce((c("canvas.width") > 0) & (c("canvas.height") > 0), F.lit(False))
    output = F.coalesce(F.startswith(c("data_url"), F.lit("data:image/")), F.lit(False)) | F.coalesce(c("has_canvas"), F.lit(False))
    some = c("n_fused") > 0
    outbound = F.struct(
        F.coalesce(c("goal"), F.lit("")).alias("goal"),
        F.struct(sanitize_url(c("url")).alias("url")).alias("page"),
        F.struct(F.coalesce(c("sanitized_text"), F.lit("")).alias("text")).alias("dom"),
        F.struct(F.coalesce(c("data_url"), F.lit("")).alias("screenshot")).alias("visual"),
        F.when(F.size("available_actions") > 0, c("available_actions")).otherwise(F.array(*map(F.lit, ACTIONS))).alias("available_actions"),
    )
    found = {
        CHECKS[0]: _first((c("sanitized_text").isNull(), "SANITIZED_DOM_MISSING"), ((c("n_regions") > 0) & (trim(c("sanitized_text")) == ""), "SANITIZED_DOM_EMPTY")),
        CHECKS[1]: _first((~screen | c("success").isNull(), "SANITIZED_SCREENSHOT_MISSING"), (~c("success"), "SANITIZED_SCREENSHOT_FAILED"), (~output, "SANITIZED_SCREENSHOT_INVALID_OUTPUT")),
        CHECKS[2]: F.when(~some, None).otherwise(_first((c("text_complete").isNull(), "TEXT_REDACTION_METADATA_MISSING"), (~c("text_complete"), "TEXT_REDACTION_INCOMPLETE"), (c("n_unredacted") > 0, "UNREDACTED_TEXT_DETECTED"))),
        CHECKS[3]: F.when(~some, None).otherwise(_first((~screen, "VISUAL_REDACTION_NOT_PERFORMED"), (c("visual_complete").isNull(), "VISUAL_REDACTION_METADATA_MISSING"), (~c("visual_complete"), "VISUAL_REDACTION_INCOMPLETE"), (c("n_unmasked") > 0, "UNMASKED_VISUAL_REGIONS_DETECTED"))),
    }
    out = rows.withColumns({f"__{k}": v for k, v in found.items()}).withColumn("__out", outbound)
    bad = forbidden_fields(out.schema["__out"].dataType)
    out = out.withColumn(f"__{CHECKS[4]}", F.lit("INVALID_OUTBOUND_SCHEMA" if bad else None).cast("string"))
    failures = F.array_compact(F.array(*[c(f"__{k}") for k in CHECKS]))
    allowed = F.size(failures) == 0
    return out.select(
        "observation_id",
        allowed.alias("allowed"),
        F.struct(*[c(f"__{k}").isNull().alias(k) for k in CHECKS]).alias("checks"),
        failures.alias("reasons"),
        F.when(allowed, c("__out")).alias("outbound"),
    )


def shut(observations: DataFrame, reason: str = "PRIVACY_GATE_UNAVAILABLE") -> DataFrame:
    """Verdicts that block every observation, for callers that cannot run the gate (or saw it fail: INTERNAL_VALIDATION_ERROR)."""
    kind = gate(observations.sparkSession.createDataFrame([], ROWS)).schema
    values = {"allowed": F.lit(False), "checks": F.struct(*[F.lit(False).alias(k) for k in CHECKS]), "reasons": F.array(F.lit(reason))}
    return observations.select("observation_id", *[values[f.name].alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]])


def outbound_json(verdicts: DataFrame) -> DataFrame:
    """observation_id and the JSON of what may leave; blocked observations give no row."""
    return verdicts.where("allowed").select("observation_id", F.to_json("outbound").alias("json"))
