"""Record types, as Spark DDL.  Absent values are null; arrays carry their order."""

from __future__ import annotations

BOX = "struct<x:double,y:double,width:double,height:double>"
WORD = f"struct<text:string,bbox:{BOX},confidence:double,start:int,end:int>"
VIEWPORT = "struct<width:double,height:double,scroll_x:double,scroll_y:double,dpr:double>"
CANVAS = "struct<width:int,height:int>"

OBSERVATIONS = f"observation_id string, url string, title string, ts timestamp, viewport {VIEWPORT}, canvas {CANVAS}, dpr double, goal string, available_actions array<string>"
ELEMENT_FIELDS = f"ord int, element_id string, tag string, type string, name string, role string, accessible_name string, text string, placeholder string, autocomplete string, has_value boolean, enabled boolean, editable boolean, checked boolean, selected string, visible boolean, in_viewport boolean, bbox {BOX}"
ELEMENTS = f"observation_id string, {ELEMENT_FIELDS}"
REGION_FIELDS = f"region_index int, element_id string, text string, bbox {BOX}, words array<{WORD}>, visible boolean, in_viewport boolean"
REGIONS = f"observation_id string, {REGION_FIELDS}"
OCR_WORDS = f"observation_id string, ord int, text string, confidence double, bbox {BOX}"
OCR_LINES = f"observation_id string, line_ord int, text string, bbox {BOX}, words array<{WORD}>"
TOKENS = "observation_id string, context_source string, item int, tok_ord int, entity string, score double, tok_index int, word string, start int, end int"
SPAN_FIELDS = "type string, text string, confidence double, reason string, start int, end int"

DETECTION_FIELDS = f"type string, source string, context_source string, element_id string, text string, confidence double, reason string, bbox {BOX}, start int, end int, region_index int, ocr_confidence double"
DETECTIONS = f"observation_id string, det_ord int, {DETECTION_FIELDS}"
DETECTION_COLUMNS = tuple(x.split()[0] for x in "type source context_source element_id text confidence reason bbox start end region_index ocr_confidence".split())
EVIDENCE = f"struct<source:string,confidence:double,text:string,bbox:{BOX},element_id:string,reason:string,context_source:string,ocr_confidence:double,start:int,end:int>"
CANONICAL = f"observation_id string, fused_ord int, {DETECTION_FIELDS}, sources array<string>, evidence array<{EVIDENCE}>"
