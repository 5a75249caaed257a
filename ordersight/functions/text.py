"""Text Column helpers: credential redaction, whitespace handling, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed redaction patterns, applied in this order (pattern, replacement).
REDACTIONS = [
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[credential-redacted]"),
    (r"(?i)\bBearer\s+\S+", "Bearer [credential-redacted]"),
    (r"(?i)OPENAI_API_KEY\s*[=:]\s*\S+", "OPENAI_API_KEY=[credential-redacted]"),
]

# White space as JavaScript's trim and \s see it (fixed values).
WS = r"[\t\n\x0B\f\r    -     　﻿]"
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def redact_credentials(c: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Chained ``regexp_replace`` over a pattern list (an argument)."""
    for pat, rep in (patterns or REDACTIONS):
        c = F.regexp_replace(c, pat, rep)
    return c


def js_trim(c: Column) -> Column:
    """Trim all leading/trailing whitespace, Unicode spaces included
    (Spark's ``trim`` only trims spaces)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse_ws(c: Column, n: int | None = None) -> Column:
    """F8: collapse whitespace runs to one space and trim; optionally keep n chars."""
    out = F.trim(F.regexp_replace(c, rf"{WS}+", " "))
    return F.substring(out, 1, n) if n else out


def pad_number(c: Column, width: int = 4) -> Column:
    """Left-pad with zeros to at least ``width`` without truncating."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), "0")
