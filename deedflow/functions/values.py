"""Small value rules: months, changes, bands and bin widths."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges of area (upper edge outside) and of floor (upper edge inside).
AREA_EDGES = (40, 60, 85, 135)
FLOOR_EDGES = (3, 10, 20)


def month_filter(ym: str, col: str = "deal_ym") -> Column:
    """Equality with a checked month, so that it reaches the scan as a partition filter."""
    if not re.fullmatch(r"[0-9]{4}(0[1-9]|1[0-2])", ym):
        raise ValueError(f"not a month: {ym!r}")
    return F.col(col) == ym


def month_no(ym: Column) -> Column:
    """Months since year 0 of a YYYYMM string: months apart is a difference of these."""
    return F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 5, 2).cast("int")


def month_text(no: Column) -> Column:
    year = F.floor((no - 1) / 12)
    return (year * 100 + no - year * 12).cast("string")


def pct_change(new: Column, old: Column) -> Column:
    """Percent change to two places; null for nothing or zero to compare with."""
    return F.round(F.try_divide((new - old) * 100.0, F.nullif(old, F.lit(0))), 2)


def band(c: Column, edges: tuple[int, ...], upper_inside: bool) -> Column:
    """0 .. len(edges); null stays null."""
    out = F.when(c.isNull(), None)
    for k, e in enumerate(edges):
        out = out.when(c <= e if upper_inside else c < e, k)
    return out.otherwise(len(edges))


def nice_width(p05: Column, p95: Column, bins: int = 16) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that cuts p05..p95 into at most `bins` parts."""
    raw = (p95 - p05) / bins
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    fit = F.lit(10.0)
    for step in (5.0, 2.5, 2.0, 1.0):
        fit = F.when(raw <= unit * step, step).otherwise(fit)
    return F.when(raw > 0, fit * unit).otherwise(1.0)


def initials(c: Column) -> Column:
    """Leading consonants of Hangul syllables; other characters stay."""
    # The 19 leading consonants in code order.
    lead = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"

    def one(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")
        # 588 = 21 vowels x 28 finals follow each leading consonant from U+AC00 on.
        return F.when((code >= 0xAC00) & (code <= 0xD7A3), F.substring(F.lit(lead), F.floor((code - 0xAC00) / 588).cast("int") + 1, 1)).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def encode_cursor(values: list, query: dict, secret: bytes) -> str:
    """A page cursor that only the same query accepts."""
    body = json.dumps([values, hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()[:16]]).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, "sha256").digest()[:16] + body).decode()


def decode_cursor(text: str, query: dict, secret: bytes) -> list:
    try:
        raw = base64.urlsafe_b64decode(text.encode())
        sign, body = raw[:16], raw[16:]
        values, mark = json.loads(body)
    except (ValueError, TypeError) as e:
        raise ValueError("bad cursor") from e
    if not hmac.compare_digest(sign, hmac.new(secret, body, "sha256").digest()[:16]) or mark != hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()[:16]:
        raise ValueError("bad cursor")
    return values
