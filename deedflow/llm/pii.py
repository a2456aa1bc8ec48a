"""Personal data in whole texts: base patterns joined with the spans that a character BiLSTM-CRF adds.

The network proposes where a span lies and of which kind it is, in whatever form it is written; a proposed span then has
to be valid for its kind, as base matches have to be: an address with a user, a host and a domain, four octets, a number
that passes Luhn, 9 to 15 digits. Base spans stay as they are; added spans touch none of them.

Defined results: null text counts as empty; a text without personal data has zero counts and the digest of the empty
string; rows that repeat an id are scanned alike; an empty table gives no rows; columns that are neither id nor text are
not read, whatever their names; of equal starts kinds come in the order email, ip, card, phone. Work per text is linear
in its length, and for its spans in their number times its logarithm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import map_text
from deedflow.llm.pii_tagger import KINDS, LONGEST, Tagger, spans_of, trained
from deedflow.llm.spans import Span, Taken, digest, joined, luhn, personal

_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|\uff20", re.IGNORECASE)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+(?:dot|\.)\s+", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DATED = re.compile(r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?:[ T].*)?")


def valid(kind: str, shown: str) -> bool:
    """Whether a proposed span is what its kind must be, with its signs read as they are meant."""
    if kind in ("email", "ip"):
        plain = _DOT.sub(".", _AT.sub("@", shown))
        if kind == "email":
            return _ADDRESS.fullmatch(plain) is not None
        parts = plain.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    digits = "".join(c for c in shown if "0" <= c <= "9")
    if any(c.isalpha() for c in shown) or re.search(r"[^0-9]{4}", shown):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not shown.isdigit() and _DATED.fullmatch(shown) is None


def added(text: str, base: list[Span], stretches) -> list[Span]:
    """Proposed spans that are valid, at most LONGEST long and touch no base span, without signs at their ends."""
    out, taken = [], Taken(base)
    for lo, tags in stretches:
        for kind, a, b in spans_of(tags):
            a, b = a + lo, b + lo
            while b > a and not (text[b - 1].isalnum() or text[b - 1] in "])}>"):
                b -= 1
            while a < b and not (text[a].isalnum() or (text[a] in "+(" and kind == "phone")):
                a += 1
            if 0 < b - a <= LONGEST and not taken.touches(a, b) and valid(kind, text[a:b]):
                out.append((kind, a, b))
    return out


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base), n_added, base_sha256, spans. One narrow pass."""
    tagger = tagger or trained()
    shown = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = shown.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = []
            for text, stretches in zip(texts, tagger.tag(texts), strict=True):
                base = personal(text)
                more = added(text, base, stretches)
                held = Counter(k for k, _, _ in base)
                rows.append([held[k] for k in KINDS] + [len(more), digest(joined(base, KINDS)), joined(base + more, KINDS)])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.string()) for c in cols[5:]], ["id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"])

    out = map_text(shown, scan, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
