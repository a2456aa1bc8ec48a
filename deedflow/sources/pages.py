"""XML pages as a source: parsing, error envelopes, bronze rows, and a paged reader."""

from __future__ import annotations

import random
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OK = ("000", "00")


def gateway_error(xml: Column) -> Column:
    """The reason code of a gateway's error envelope; null for any other document."""
    code = F.trim(F.xpath_string(xml, F.lit("/OpenAPI_ServiceResponse/cmmMsgHeader/returnReasonCode")))
    return F.when(F.xpath_boolean(xml, F.lit("/OpenAPI_ServiceResponse")), F.nullif(code, F.lit("")))


def parse_pages(pages: DataFrame, fields: list[str], xml: str = "xml") -> DataFrame:
    """pages with error (code of a failed response), total_count, page_no and items, an array of maps of raw strings.

    Blank values keep their spaces; a field that an item lacks is not in its map.
    """
    doc = F.col(xml)
    text = lambda path: F.xpath_string(doc, F.lit(path))
    code = F.trim(text("//resultCode"))
    error = F.coalesce(gateway_error(doc), F.when(F.xpath_boolean(doc, F.lit("/OpenAPI_ServiceResponse")), "UNKNOWN"), F.when(~code.isin(*OK), F.when(code == "", "UNKNOWN").otherwise(code)))
    df = pages.withColumns({"error": error, "total_count": F.xpath_int(doc, F.lit("//body/totalCount")), "page_no": F.xpath_int(doc, F.lit("//body/pageNo"))})
    # Items are parsed in Arrow batches: xpath cannot keep absent fields of an item apart from blank ones.
    return df.mapInPandas(_items_of(fields, xml), T.StructType([*df.schema.fields, T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("parsed", T.BooleanType())]))


def _items_of(fields: list[str], xml: str) -> Callable:
    known = set(fields)

    def run(frames):
        for f in frames:
            items, parsed = [], []
            for text in f[xml]:
                try:
                    root = ET.fromstring(text)
                    items.append([{c.tag: c.text or "" for c in item} for item in root.iterfind("./body/items/item")])
                    parsed.append(all(k in known for item in items[-1] for k in item))
                except (ET.ParseError, TypeError):
                    items.append([])
                    parsed.append(False)
            yield f.assign(items=items, parsed=parsed)

    return run


def bronze_rows(pages: DataFrame) -> DataFrame:
    """One row an item: row_json with sorted keys, row_ord, and the page's lineage columns."""
    keep = [c for c in pages.columns if c not in ("items", "xml", "parsed", "error", "total_count")]
    rows = pages.select(*keep, F.posexplode("items").alias("row_ord", "row"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("row")))
    return rows.withColumn("row_json", F.to_json(ordered))


def payload_hash(pages: DataFrame, by: list[str]) -> DataFrame:
    """One hash of all pages of a load, in page order."""
    s = F.array_sort(F.collect_list(F.struct("page_no", F.sha2(F.encode("xml", "UTF-8"), 256).alias("h"))))
    return pages.groupBy(*by).agg(F.sha2(F.array_join(F.transform(s, lambda x: x["h"]), "|"), 256).alias("payload_sha256"))


class TokenBucket:
    """At most `rate` calls a second; clock and sleep can be replaced in tests."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.tokens, self.at = rate, clock, sleep, max(rate, 1.0), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(max(self.rate, 1.0), self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


# Reason codes of the source that a retry may better, that close it for the day, and that reject the key.
RETRYABLE, QUOTA, ACCOUNT = {"01", "02", "04", "05"}, {"22"}, {"20", "30", "31", "32"}


class LoadFailed(Exception):
    """A load that cannot be had; code is the source's reason, null if it could not be reached or was incomplete."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code


class SourceClosed(Exception):
    """Every further call would fail alike: the quota is used up or the key is rejected. Says nothing about the load."""


def page_of(text: str) -> tuple[int, int]:
    """(items, total count) of a page. An error envelope or a result code other than success raises LoadFailed."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise LoadFailed("not XML", "UNKNOWN") from e
    if root.tag == "OpenAPI_ServiceResponse":
        code = (root.findtext("./cmmMsgHeader/returnReasonCode") or "").strip()
        raise LoadFailed("gateway error", code or "UNKNOWN")
    code = (root.findtext("./header/resultCode") or "").strip()
    if code not in OK:
        raise LoadFailed("source error", code or "UNKNOWN")
    return len(root.findall("./body/items/item")), int(root.findtext("./body/totalCount") or 0)


def _refused(e: HTTPError) -> Exception | None:
    """What a client error means; null for a server error, which may pass."""
    if e.code >= 500:
        return None
    try:
        page_of(e.read().decode("utf-8", "replace"))
        reason = None
    except LoadFailed as inner:
        reason = None if inner.code == "UNKNOWN" else inner.code
    if e.code == 429 or reason in QUOTA:
        return SourceClosed(f"quota: HTTP {e.code} {reason}")
    if reason in ACCOUNT or (reason is None and e.code in (401, 403)):
        return SourceClosed(f"key: HTTP {e.code} {reason}")
    return LoadFailed(f"HTTP {e.code}", reason or str(e.code))


def fetch_page(get: Callable[[int], str], no: int, bucket: TokenBucket, attempts: int = 3, base: float = 1.0, jitter: Callable[[], float] = lambda: random.random() * 0.2) -> tuple[str, int, int]:
    """(text, items, total count) of a page. What may pass is tried again with growing delays: a source that cannot be
    reached, server errors and the source's own passing errors. Client errors are not."""
    for k in range(attempts):
        bucket.take()
        try:
            text = get(no)
            return text, *page_of(text)
        except HTTPError as e:
            if (refused := _refused(e)) is not None:
                raise refused from e
            last = LoadFailed(f"HTTP {e.code}")
        except LoadFailed as e:
            if e.code in QUOTA or e.code in ACCOUNT:
                raise SourceClosed(f"{'quota' if e.code in QUOTA else 'key'}: {e.code}") from e
            if e.code not in RETRYABLE:
                raise
            last = LoadFailed(str(e))
        except OSError as e:
            last = LoadFailed(type(e).__name__)
        if k < attempts - 1:
            bucket.sleep(base * 2**k + jitter())
    raise last


def fetch_all(get: Callable[[int], str], bucket: TokenBucket, attempts: int = 3, base: float = 1.0, jitter: Callable[[], float] = lambda: random.random() * 0.2) -> list[str]:
    """All pages of a load; the number of items must be what the first page announces."""
    pages, seen, total, no = [], 0, None, 1
    while total is None or seen < total:
        text, items, announced = fetch_page(get, no, bucket, attempts, base, jitter)
        total = announced if total is None else total
        pages.append(text)
        seen, no = seen + items, no + 1
        if not items and seen < total:
            break
    if seen != total:
        raise LoadFailed(f"incomplete load: {seen} of {total}")
    return pages


class _Lane(InputPartition):
    def __init__(self, loads: list[tuple[str, str]]):
        self.loads = loads


class PagedReader(DataSourceReader):
    """Loads (district, month) dealt to `lanes` input partitions, which share the rate among them; a URL template names
    the page, and file: templates work offline.

    A load that fails gives one row with page_no 0 and its error. When the source closes, the lane makes no more calls
    and its other loads are given as skipped.
    """

    def __init__(self, options):
        self.options = options
        self.lanes = int(options.get("lanes", "4"))

    def partitions(self):
        loads = [(d, m) for m in self.options["months"].split(",") for d in self.options["districts"].split(",")]
        return [_Lane(loads[k :: self.lanes]) for k in range(min(self.lanes, len(loads)))]

    def read(self, part) -> Iterator[tuple]:
        url, closed = self.options["url"], None
        bucket = TokenBucket(float(self.options.get("rate", "10")) / self.lanes)
        for district, month in part.loads:
            if closed:
                yield district, month, 0, None, f"skipped: {closed}"
                continue

            def get(no: int, district=district, month=month) -> str:
                with urlopen(url.format(district=quote(district), month=month, page=no), timeout=30) as r:
                    return r.read().decode()

            try:
                for no, text in enumerate(fetch_all(get, bucket), 1):
                    yield district, month, no, text, None
            except SourceClosed as e:
                closed = str(e)
                yield district, month, 0, None, closed
            except LoadFailed as e:
                yield district, month, 0, None, e.code or str(e)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_xml").options(url=, districts=, months=)."""

    @classmethod
    def name(cls) -> str:
        return "paged_xml"

    def schema(self) -> str:
        return "sgg_cd string, deal_ym string, page_no int, xml string, fetch_error string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
