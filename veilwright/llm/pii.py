"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score.

Row-local (one Arrow pass, no shuffle).  Every search is linear in the text: runs are taken
possessively from their left end, and an address is looked up from its ``@``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from veilwright.llm.common import id_and_text, parts

#: Base kinds in output order, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id")
WINDOW = 48
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ENDS = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Prior score of a confirmed span, and beginnings of words (English, German, French, Spanish) that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4}
RAISE = {
    "email": ("mail", "email", "contact", "kontakt", "writ", "schreib", "courriel", "correo", "reach", "address", "adress"),
    "ip": ("ip", "host", "server", "serv", "address", "adress", "client", "network", "netz", "rout", "gateway", "dns"),
    "card": ("card", "karte", "carte", "tarjeta", "visa", "master", "amex", "credit", "kredit", "debit", "pay", "zahl", "paiement", "pago", "cvv", "expir"),
    "phone": ("call", "phon", "telephon", "telefon", "telefono", "tel", "mobil", "cell", "handy", "fax", "anruf", "appel", "llam", "whatsapp", "sms", "contact", "kontakt", "dial"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "banque", "banco", "bic", "swift", "transfer", "wire", "ueberweis", "virement"),
    "national_id": ("ssn", "social", "security", "national", "identi", "taxpayer", "tin", "insurance"),
}
#: Beginnings of words that lower any score, and of words for numbers of other kinds.
LOWER = ("example", "sampl", "beispiel", "exemple", "ejemplo", "test", "dummy", "fake", "placeholder", "version", "release", "order", "bestell", "commande", "pedido", "invoice", "rechnung", "factur", "serial", "isbn", "section", "chapter")
MOVE = 0.25
#: Stems this short only match whole words.
SHORT = 3
_WORD = re.compile(r"[a-z]+")


def _said(kind: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{s}$)" if len(s) <= SHORT else s for s in sorted(RAISE[kind] if kind else LOWER, key=len, reverse=True)))


_FOR, _AGAINST = {kind: _said(kind) for kind in PRIOR}, _said("")


def luhn(digits: str) -> bool:
    """Whether the digits pass the mod-10 check."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number passes the mod-97 check."""
    text = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for domain in _DOMAIN.finditer(text):
        at = start = domain.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((start, domain.end()))
            last = domain.end()
    return found


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers; of the ends that close a group of characters, the last one that passes mod-97 counts."""
    found, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        # one character more, as a search does not look beyond its end
        for end in reversed([e.end() for e in _ENDS.finditer(text, m.start(), m.end() + 1) if e.end() <= m.end()]):
            if len(text[m.start() : end].replace(" ", "")) < 15:
                break
            if mod97(text[m.start() : end]):
                found.append((m.start(), end))
                at = end
                break
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then by start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def _closest(words: re.Pattern, near: list[tuple[str, int]]) -> float:
    """1 for such a word beside the span, less with its distance, 0 without one within ``WINDOW`` characters."""
    return max((1 - distance / (WINDOW + 1) for word, distance in near if words.match(word)), default=0.0)


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the kind, moved up and down by the closest telling words within ``WINDOW`` characters on either side."""
    left, right = text[max(0, start - WINDOW) : start].lower().replace("e-mail", "email"), text[end : end + WINDOW].lower().replace("e-mail", "email")
    near = [(m[0], len(left) - m.end()) for m in _WORD.finditer(left)] + [(m[0], m.start()) for m in _WORD.finditer(right)]
    moved = PRIOR[kind] + MOVE * (_closest(_FOR[kind], near) - _closest(_AGAINST, near))
    return round(min(1.0, max(0.0, moved)), 3)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with scores: the base spans, then added ones that a checksum or nearby words confirm."""
    text = text or ""
    out = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    out += [("iban", a, b, score(text, "iban", a, b)) for a, b in _ibans(text)]
    for m in _NATIONAL.finditer(text):
        s = score(text, "national_id", *m.span())
        if s >= ACCEPT and m[0][:3] not in ("000", "666") and m[0][0] != "9":
            out.append(("national_id", *m.span(), s))
    return out


def _joined(rows) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in rows)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, a digest of the base spans, all spans, their scores.

    Offsets count code points, ends are exclusive.  Null text counts as empty: zero counts, the
    digest of the empty string, empty lists.  An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)

    def searched(batches):
        for batch in parts(batches):
            out = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                found = spans(text)
                base = [x for x in found if x[0] in BASE]
                counts = [sum(x[0] == k for x in base) for k in BASE]
                values = (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), ",".join(str(x[3]) for x in found))
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", *names])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return rows.mapInArrow(searched, f"doc_id {rows.schema[0].dataType.simpleString()}, {counts}, base_sha256 string, spans string, scores string")
