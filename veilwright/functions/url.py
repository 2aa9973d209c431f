"""URLs that may leave: origin and path only."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Schemes that may leave, and default ports.
SCHEMES = ("http", "https", "chrome-extension")
PORTS = {"http": "80", "https": "443"}

#: Addresses whose parsing needs no special case: plain ASCII, no user, no default port, no dot segments.
PLAIN = r"^(https?)://[a-z0-9-]+(\.[a-z0-9-]*[a-z][a-z0-9-]*)+(/[A-Za-z0-9._~!$&'()*+,;=:@%-]*)*([?#].*)?$"
_DOTS = r"/(\.|%2[eE]){1,2}(/|$|\?|#)"


def sanitize(raw: str | None) -> str:
    """Origin and path of an address with an allowed scheme, else the empty string."""
    if not raw:
        return ""
    text = raw.strip("".join(map(chr, range(33)))).translate({9: None, 10: None, 13: None})
    scheme = text.partition(":")[0].lower()
    if scheme not in SCHEMES or ":" not in text:
        return ""
    rest = text.split(":", 1)[1]
    if scheme in PORTS:
        rest = "//" + rest.split("#")[0].split("?")[0].replace("\\", "/").lstrip("/")
    try:
        parts = urlsplit(f"{scheme}:{rest}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ""
    if not host or any(c in host for c in " <>^|%"):
        return ""
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return ""
    host = f"[{host}]" if ":" in host else host
    shown = f":{port}" if port is not None and str(port) != PORTS.get(scheme) else ""
    kept: list[str] = []
    segments = parts.path.split("/")[1:] if parts.path else [""]
    for k, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots in (".", ".."):
            if dots == ".." and kept:
                kept.pop()
            if k == len(segments) - 1:
                kept.append("")
        else:
            kept.append(quote(s, safe="!$%&'()*+,;=:@-._~[]|^\\"))
    return f"{scheme}://{host}{shown}/" + "/".join(kept)


@F.pandas_udf(StringType())
def _sanitize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(sanitize)


def sanitize_plain(url: Column) -> Column:
    """The native form, for addresses that match ``PLAIN``."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(base.rlike("^https?://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)


def sanitize_url(url: Column) -> Column:
    """Native for plain addresses; the others go to an Arrow function; null gives the empty string."""
    plain = url.rlike(PLAIN) & ~url.rlike(_DOTS)
    return F.when(plain, sanitize_plain(url)).otherwise(F.coalesce(_sanitize_udf(F.when(~F.coalesce(plain, F.lit(False)), url)), F.lit("")))
