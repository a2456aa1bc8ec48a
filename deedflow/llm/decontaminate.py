"""Benchmark decontamination by a positional inverted index (DataFrame functions only).

Every benchmark item is cut into windows of WINDOW words. A first pass counts how often the benchmark's words occur in
the corpus; each window takes its `lists` rarest words. The index stores the corpus postings (word, document,
position) of these words alone: common words, which make almost all postings, are never stored. Posting lists are
adjusted by the word's place in the item, so that all words of one occurrence agree on the same shift; shifts where a
window's rare words all meet are candidates. Candidates are compared word by word with the text, so the result is
exact. Proximity matches come out of the same lists, with a tolerance on the shifts: an item is near a document if all
rare words of one of its windows stand there within `slack` places of where they belong, counted from the first of them.

What is broadcast comes from the benchmark or is a list of ids, and only behind a count; beyond that it is joined by
shuffle, and words are counted before they are dealt. Only texts of candidate documents are ever dealt out.

Defined results: null and empty texts have no words and no hits; items without words are skipped; items of fewer words
than a window are one window; items that repeat an id are texts of one item; of words that tie in number the first in
the window is the rarer; texts of any length are read whole, and a document's hits are at most its windows times the
items that share one; rows that repeat a doc id repeat its answer; empty tables give no rows or no hits; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.llm.common import cut, cut_few, small

WINDOW = 10
LISTS = 2
SLACK = 3
IDS = 1_000_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text after lower-casing A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, _BREAK), "")


def _items(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(key, item, w, len, starts): key tells items apart, also those that repeat an id."""
    items = bench.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    return items.select(F.xxhash64("item", "w").alias("key"), "item", "w", F.least(F.size("w"), F.lit(window)).alias("len"))


def _windows(items: DataFrame) -> DataFrame:
    """(key, s, off, term): each word of each window."""
    starts = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    return items.select("key", "w", "len", F.explode(starts).alias("s")).select("key", "s", F.posexplode(F.slice("w", F.col("s") + 1, F.col("len"))).alias("off", "term"))


def postings(docs: DataFrame) -> DataFrame:
    """(id, pos, term) of docs (id, t)."""
    return docs.select("id", F.posexplode(words(F.col("t"))).alias("pos", "term"))


def _rarest(windows: DataFrame, docs: DataFrame, lists: int) -> DataFrame:
    """(key, s, p, term): of each window that can occur, the places in its item of its rarest words."""
    terms, count = cut_few(windows.select("term").distinct()), F.count(F.lit(1)).alias("c")
    known, seen = small(terms), postings(docs).select("term")
    # Few terms are broadcast to the postings; many are met by the postings' counts, which no common word makes uneven.
    counts = seen.join(known, "term").groupBy("term").agg(count) if known is not terms else seen.groupBy("term").agg(count).join(terms, "term")
    counts = cut_few(counts)
    ranked = windows.join(small(counts), "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own = W.partitionBy("key", "s")
    ranked = ranked.withColumn("least", F.min("c").over(own)).withColumn("k", F.row_number().over(own.orderBy("c", "off")))
    return cut_few(ranked.where((F.col("least") > 0) & (F.col("k") <= lists)).select("key", "s", (F.col("s") + F.col("off")).alias("p"), "term"))


def _index(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """The stored postings of the rare words."""
    return cut(postings(docs).join(small(rare.select("term").distinct()), "term"))


def _candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, key, shift, s): windows all of whose rare words stand in the document at one shift."""
    places = small(rare.select("term", "key", "p").distinct())
    met = index.join(places, "term").select("id", "key", (F.col("pos") - F.col("p")).alias("shift"), "p")
    met = met.groupBy("id", "key", "shift").agg(F.collect_set("p").alias("ps"))
    needs = rare.groupBy("key", "s").agg(F.collect_set("p").alias("need"))
    needs = small(needs.groupBy("key").agg(F.collect_list(F.struct("s", "need")).alias("wins")))
    hits = F.filter("wins", lambda w: (F.size(F.array_except(w["need"], F.col("ps"))) == 0) & (F.col("shift") + w["s"] >= 0))
    return met.join(needs, "key").select("id", "key", "shift", F.transform(hits, lambda w: w["s"]).alias("starts")).where(F.size("starts") > 0)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, lists: int = LISTS, ids: int = IDS, slack: int | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    With slack also n_near: the items of which a window is near, exact ones included.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    items = cut_few(_items(bench, item_col, item_text, window))
    rare = _rarest(_windows(items), named, lists)
    index = _index(named, rare)
    found = _candidates(index, rare).join(small(items), "key")
    found = cut(found.groupBy("id").agg(F.collect_list(F.struct("item", "w", "len", "shift", "starts")).alias("found")))
    # Only candidate documents go on with their texts.
    likely = small(found.select(F.col("id").alias("i")), ids)
    texts = named.join(likely, F.col("id").eqNullSafe(F.col("i")), "left_semi")
    texts = texts.join(found.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i"))).select("id", "t", "found")
    same = lambda d, c: lambda s: F.slice(d, c["shift"] + s + 1, c["len"]) == F.slice(c["w"], s + 1, c["len"])
    spans = lambda d: lambda c: F.transform(F.filter(c["starts"], same(d, c)), lambda s: F.struct(c["item"].alias("item"), (c["shift"] + s).alias("a"), (c["shift"] + s + c["len"] - 1).alias("z")))
    # The words are bound by an outer function, so that they are split once a document and not once a window.
    true = F.transform(F.array(words(F.col("t"))), lambda d: F.flatten(F.transform("found", spans(d))))[0]
    hits = texts.select("id", true.alias("hits")).where(F.size("hits") > 0)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["a"], h["z"])))))
    names = F.array_sort(F.transform(F.array_distinct(F.transform("hits", lambda h: h["item"])), lambda x: x.cast("string")))
    # Rows that repeat an id have equal texts, so any of them stands for all.
    hits = hits.select("id", covered.cast("long").alias("n_hit"), names.alias("items")).groupBy(F.col("id").alias("i")).agg(F.max(F.struct("n_hit", "items")).alias("r"))
    sized = named.select("id", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    out = sized.join(hits, F.col("id").eqNullSafe(F.col("i")), "left")
    none = F.array().cast("array<string>")
    out = out.select("id", "n_words", F.coalesce("r.n_hit", F.lit(0)).alias("n_hit"), F.coalesce("r.items", none).alias("items"))
    more = []
    if slack is not None:
        counts = _near(index, rare, items, slack).groupBy(F.col("id").alias("i")).agg(F.count_distinct(F.struct("item")).alias("n"))
        out = out.join(counts, F.col("id").eqNullSafe(F.col("i")), "left")
        more = [F.coalesce("n", F.lit(0)).cast("long").alias("n_near")]
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), *more)


def _near(index: DataFrame, rare: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """(id, item, at): windows all of whose rare words stand within slack of where they belong."""
    heads = small(cut_few(rare.groupBy("key", "s").agg(F.min("p").alias("head"), F.count(F.lit(1)).alias("need"))))
    met = index.join(small(rare), "term").groupBy("id", "key", "s").agg(F.collect_list(F.struct("p", "pos")).alias("ms"))
    # Most documents hold one of a window's rare words and not the others.
    whole = met.join(heads, ["key", "s"]).where(F.size(F.array_distinct(F.col("ms.p"))) == F.col("need"))
    here = lambda f, m: F.abs(m["pos"] - m["p"] - f["pos"] + f["p"]) <= slack
    full = lambda f: F.size(F.array_distinct(F.transform(F.filter("ms", lambda m: here(f, m)), lambda m: m["p"]))) == F.col("need")
    at = F.transform(F.filter("ms", lambda f: (f["p"] == F.col("head")) & full(f)), lambda f: f["pos"])
    found = whole.select("id", "key", F.explode(at).alias("at"))
    return found.join(small(items), "key").select("id", "item", "at").distinct()


def near(docs: DataFrame, bench: DataFrame, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(id, item, at) proximity matches; at is the position of the first rare word."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    items = cut_few(_items(bench, item_col, item_text, window))
    rare = _rarest(_windows(items), named, lists)
    found = _near(_index(named, rare), rare, items, slack)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "at")
