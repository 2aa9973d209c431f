"""Settings and fixed values of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Options; the defaults give the documented behaviour.

    ``strict`` closes known gaps: phones need a left boundary, evidence offsets must match their
    text exactly, and every evidence text of an entity is redacted, not only the first that hits.
    """

    min_confidence: float = 0.50
    y_tolerance_ratio: float = 0.5
    max_gap_ratio: float = 2.5
    mask_color: tuple[int, int, int, int] = (0, 0, 0, 255)
    mask_padding: float = 2
    scale: float = 2.0
    box_tolerance: float = 8
    strict: bool = False


DEFAULT = EngineConfig()

# Entity types.
STRUCTURED_TYPES = ("EMAIL", "PHONE", "CARD", "URL", "TAX_ID", "BANK_ACCOUNT", "ROUTING_NUMBER", "GOVERNMENT_ID", "PASSPORT", "DRIVERS_LICENSE")
NAME_TYPES = ("GIVEN_NAME", "SURNAME", "NAME")
ADDRESS_TYPES = ("BUILDING_NUMBER", "STREET_NAME", "SECONDARY_ADDRESS", "CITY", "STATE", "ZIP_CODE")
ALL_TYPES = ("PASSWORD", "EMAIL", "PHONE", "CARD", *NAME_TYPES, *ADDRESS_TYPES, *STRUCTURED_TYPES[3:])
NEVER_FUZZY = (*STRUCTURED_TYPES, "ZIP_CODE")
COMPACT_TYPES = ("CARD", "ZIP_CODE", "TAX_ID", "BANK_ACCOUNT", "ROUTING_NUMBER")

# Candidate thresholds of tagger output by type.
THRESHOLDS = {"GIVEN_NAME": 0.55, "SURNAME": 0.55, "NAME": 0.55, "BUILDING_NUMBER": 0.80, "STREET_NAME": 0.80, "SECONDARY_ADDRESS": 0.80, "CITY": 0.75, "STATE": 0.75, "ZIP_CODE": 0.80}
DEFAULT_THRESHOLD = 0.80

# Detection sources as they stand in records; the last one marks tagger output.
SOURCES = ("DOM", "DOM_TEXT", "OCR", "RAMPART")

# Reliability of sources.
PRIORITY = {"DOM": 5, "DOM_TEXT": 4, "OCR": 3, "RAMPART_DOM": 2, "RAMPART_OCR": 1}

# Placeholders by type.
PLACEHOLDERS = {
    "GIVEN_NAME": "[PERSON]",
    "SURNAME": "[PERSON]",
    "NAME": "[PERSON]",
    "EMAIL": "[EMAIL]",
    "PHONE": "[PHONE]",
    "CARD": "[CARD]",
    "BUILDING_NUMBER": "[ADDRESS]",
    "STREET_NAME": "[ADDRESS]",
    "SECONDARY_ADDRESS": "[ADDRESS]",
    "CITY": "[ADDRESS]",
    "STATE": "[ADDRESS]",
    "ZIP_CODE": "[ADDRESS]",
    "URL": "[URL]",
    "PASSWORD": "[PASSWORD]",
}
OTHER_PLACEHOLDER = "[REDACTED]"
SPECIFIC_PLACEHOLDERS = ("[EMAIL]", "[PHONE]", "[CARD]")
WEAK_PLACEHOLDERS = ("[REDACTED]", "[PERSON]")

# Actions offered by default, and keys that must never leave.
ACTIONS = ("click", "type", "scroll", "select", "wait", "finish")
FORBIDDEN_KEYS = (
    "allRawDetections",
    "contextFilteredDetections",
    "fusedDetections",
    "rawOCR",
    "ocrResults",
    "evidence",
    "bboxes",
    "trace",
    "pageState",
    "canvas",
    "metadata",
    "tokens",
    "password",
    "api_key",
    "apiKey",
    "secret",
    "confidence",
    "rampart",
)

# Parents whose text is not shown.
HIDDEN_PARENTS = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "input")
