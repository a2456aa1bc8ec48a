"""Site-relative line deduplication (DataFrame functions only).

Rows are grouped by host. A line is boilerplate of a host if the share of the host's pages that hold it exceeds a
ratio, and at least `least` pages hold it. Boilerplate lines go from every page of that host; all others stay.

Two passes make the result exact while only hashes move at first. A page sends each of its different lines once, as a
hash, to a partial aggregate by (host, hash), so one host with a third of all pages is spread over its lines. A hash
is held by as many pages as its lines together, so the hashes that pass the rule are a superset of the boilerplate.
The second pass counts the lines themselves, and only those under a hash that passed. A line is dropped only if it is
equal to a listed line. A host has at most (its mean lines a page) / ratio boilerplate lines. If the lists of all hosts are
measured to be small they are broadcast and no text moves; beyond that, pages and lists meet by (host, hash), and what
comes back to a page is its own part of its host's list.

Defined results: null text counts as empty (one blank line); a line of nothing but U+0020 and U+0009 to U+000D is
blank, is no boilerplate and stays; null is a host like any other; texts of any length are split whole; lines held by
exactly `ratio` of the pages stay; rows that repeat an id are pages of their own and get the same lines removed; an
empty table gives no rows. Columns that are neither id, text nor host are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import cut_few

RATIO = 0.05
LEAST = 3
#: The lists of all hosts are broadcast up to this many characters.
LISTED_CHARS = 16_000_000


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without a leading "www."; null if it names none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def html_lines(html: Column) -> Column:
    """Markup as text with one line a block element: a line break after every block tag, other tags out, ends trimmed."""
    blocks = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, blocks, "\n"), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", "\n"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _seen(text: Column) -> Column:
    """Hashes of the different lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)))


def _over(counts: DataFrame, totals: DataFrame, ratio: float, least: int) -> DataFrame:
    held = counts.where(F.col("c") >= least)
    return held.join(totals, "host").where(F.col("c") > F.col("total") * F.lit(ratio)).drop("c", "total")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, chars: int = LISTED_CHARS) -> DataFrame:
    """(host, h, line) of pages (host, t): the boilerplate lines of each host and their hashes."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))  # one row a host; its measured size decides how it is joined
    hashes = pages.select("host", F.explode(_seen(F.col("t"))).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("c"))
    likely = cut_few(_over(hashes, totals, ratio, least))
    lists = likely.groupBy("host").agg(F.collect_list("h").alias("hs"))
    if likely.count() * 8 <= chars:
        # The pages stay where they are; each counts its own lines under the host's hashes.
        near = pages.join(F.broadcast(lists), "host")
        lines = near.select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("t")), lambda x: F.array_contains(F.col("hs"), F.xxhash64(x))))).alias("line"))
    else:
        lines = pages.select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("t")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))).alias("line"))
        lines = lines.withColumn("h", F.xxhash64("line")).join(likely, ["host", "h"], "left_semi").drop("h")
    return _over(lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("c")), totals, ratio, least).select("host", F.xxhash64("line").alias("h"), "line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", ratio: float = RATIO, least: int = LEAST, carry: bool = False, listed_chars: int = LISTED_CHARS) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept (the lines left, joined by line feeds).

    With carry also a struct, row, of all of the row's columns.
    """
    key = F.col(host) if isinstance(host, str) else host
    # Null becomes a value of its own, so that plain equality joins it.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(None)
    pages = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).alias("host"), row.alias("row"))
    listed = cut_few(boilerplate(pages, ratio, least, listed_chars))
    sized = listed.agg(F.coalesce(F.sum(F.char_length("line") + 8), F.lit(0))).first()[0]
    if sized <= listed_chars:
        lists = listed.groupBy("host").agg(F.collect_list("h").alias("hs"), F.collect_list("line").alias("dropped"))
        marked = pages.join(F.broadcast(lists), "host", "left")
    else:
        # A page's lines meet the list by (host, hash); what returns is the listed lines that the page may hold.
        lines = pages.select("id", "host", F.explode(_seen(F.col("t"))).alias("h"))
        own = lines.join(listed, ["host", "h"]).groupBy("id", "host").agg(F.collect_set("h").alias("hs"), F.collect_set("line").alias("dropped")).withColumnRenamed("id", "i").withColumnRenamed("host", "o")
        marked = pages.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("host") == F.col("o")), "left")
    kept = marked.select("id", "row", _lines(F.col("t")).alias("lines"), "hs", "dropped")
    stays = lambda x: ~(F.array_contains("hs", F.xxhash64(x)) & F.array_contains("dropped", x))
    kept = kept.select("id", "row", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("hs").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("left"))
    return kept.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"), F.array_join("left", "\n").alias("kept"), *(["row"] if carry else []))
