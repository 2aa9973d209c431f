"""Rows of the engine's tables for tests."""

import re


def box(x, y, w, h):
    return {"x": float(x), "y": float(y), "width": float(w), "height": float(h)}


def element(i, tag, type=None, name=None, placeholder=None, autocomplete=None, text="", acc="", obs="o1"):
    return (obs, i, f"e{i + 1}", tag, type, name, "textbox", acc, text, placeholder, autocomplete, False, True, True, None, None, True, True, box(10, 10 + 40 * i, 200, 30))


def region(i, text, obs="o1", x=20):
    words = [{"text": m[0], "bbox": box(x + 8 * m.start(), 200 + 30 * i, 8 * len(m[0]), 20), "confidence": None, "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", text)]
    return (obs, i, None, text, box(x, 200 + 30 * i, 300, 20), words, True, True)


def observation(obs="o1", url="https://u:p@ex.com:443/a?b#c", canvas=(1600, 800), viewport=(800.0, 400.0)):
    view = viewport and {"width": viewport[0], "height": viewport[1], "scroll_x": 0.0, "scroll_y": 0.0, "dpr": 1.0}
    return (obs, url, "t", None, view, canvas and {"width": canvas[0], "height": canvas[1]}, None, "goal", None)


def detection(k, type, text, source="DOM_TEXT", context=None, bbox=None, conf=0.9, element_id=None, reason="r", start=None, end=None, obs="o1", region_index=None, ocr=None):
    return (obs, k, type, source, context, element_id, text, conf, reason, bbox, start, end, region_index, ocr)
