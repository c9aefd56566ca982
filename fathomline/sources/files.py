"""Texts of fetched files that are no HTML."""

from __future__ import annotations

import re
from datetime import datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.urls import title_from_url

TYPES = ("application/pdf", "text/plain", "text/csv", "text/markdown", "application/xml", "text/xml")
MOST = 100_000
_HEX = re.compile(rb"<(?!<)([^<>]{1,199})>")
_BLOCK = re.compile(rb"BT.*?ET", re.S)


def is_readable(text: str) -> bool:
    """More than seven of ten characters are letters, digits, blanks or common marks."""
    return bool(text) and sum(c.isalnum() or c.isspace() or c in ".,;:!?-'\"()/%&" for c in text) > 0.7 * len(text)


def _strings(data: bytes):
    """Bracketed strings with their nested brackets and escapes, text blocks passed over."""
    i, n = 0, len(data)
    while i < n:
        if data[i : i + 2] == b"BT":
            m = _BLOCK.match(data, i)
            i = m.end() if m else n
        elif data[i : i + 1] == b"(":
            out, depth = bytearray(), 1
            i += 1
            while i < n and depth:
                c = data[i : i + 1]
                if c == b"\\" and i + 1 < n:
                    i += 1
                    out += data[i : i + 1]
                elif c == b"(":
                    depth += 1
                    out += c
                elif c == b")":
                    depth -= 1
                    out += c if depth else b""
                else:
                    out += c
                i += 1
            yield bytes(out)
        else:
            i += 1


def pdf_text(data: bytes | None) -> str:
    """Readable strings of a PDF, bracketed ones then hexadecimal ones, at most MOST characters."""
    data = data or b""
    parts = [x.decode("latin-1") for x in _strings(data)]
    for m in _HEX.finditer(data):
        digits = re.sub(rb"\s", b"", m[1])
        if re.fullmatch(rb"(?:[0-9A-Fa-f]{2})+", digits):
            parts.append(bytes.fromhex(digits.decode()).decode("latin-1"))
    kept = [p for p in parts if len(p) > 1 and is_readable(p)]
    return re.sub(r"[ \t\n\r]+", " ", " ".join(kept)).strip()[:MOST]


def plain_text(data: bytes | None) -> str:
    """The text of a plain file: broken UTF-8 repaired, white space collapsed."""
    return re.sub(r"[ \t\n\r]+", " ", (data or b"").decode("utf-8", "replace")).strip()[:MOST]


def texts(files: DataFrame, url: str = "url", kind: str = "content_type", data: str = "data") -> DataFrame:
    """(url, title, content): one row per file of a known type; title from the URL."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    f = files.where(F.exists(F.array(*[F.lit(t) for t in TYPES]), lambda t: F.contains(low, t)))

    @F.pandas_udf("string")
    def read(is_pdf, body):
        return body.combine(is_pdf, lambda b, p: pdf_text(b) if p else plain_text(b))

    return f.select(url, title_from_url(F.col(url)).alias("title"), read(F.contains(low, F.lit("pdf")), F.col(data)).alias("content"))


def retry_after(header: str | None, now: datetime) -> float:
    """Seconds to wait by a Retry-After header, a number or a date: within one second and five minutes, 30 without a usable one."""
    h = (header or "").strip()
    if m := re.match(r"[+-]?\d+", h):
        return float(max(1, min(300, int(m[0]))))
    try:
        return float(max(1.0, min(300.0, (parsedate_to_datetime(h) - now).total_seconds()))) if h else 30.0
    except (ValueError, TypeError):
        return 30.0
