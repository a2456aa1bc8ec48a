"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only).

Level one counts rows by length, a partial aggregate of one row a different length. Level two hashes the prefix of
rows of a length that is held twice or more, and of no others. Level three groups by full hash those rows alone whose
length and prefix are both held twice or more. Groups are never gathered: counts and the row to keep are partial
aggregates, and the join back is an ordinary equi-join that AQE splits when one group of copies holds a large share
of the rows.

Defined results: null text counts as empty, all empty texts are equal; of rows that tie in length and id any stands for
all; rows that repeat an id repeat its answer if their texts are equal, and are documents of their own if not; texts of
any length are read whole; an empty table gives no rows. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import cut, cut_few, small

PREFIX = 64


def normalised(text: Column) -> Column:
    """Text without white space: U+0020 and U+0009 to U+000D."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    text_sha256 is the digest of the normalised text; without digest_all it is null for rows that length or prefix
    alone prove unique, whose full content is then never hashed.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", F.char_length("t").alias("n"), normalised(F.col("t")).alias("u"))
    # Level one: a text's length in code points, of which there are no more than the longest text has.
    sized = raw.select("id", "n", "u", F.char_length("u").alias("len"))
    lengths = small(cut_few(sized.groupBy("len").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("len", F.lit(True).alias("again"))))
    # Level two: prefix hashes of the rows that level one leaves.
    headed = sized.join(lengths, "len", "left").withColumn("head", F.when(F.col("again"), F.xxhash64(F.substring("u", 1, prefix))))
    heads = headed.where("again").groupBy("len", "head").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("len", "head", F.lit(True).alias("live"))
    digest = F.sha2(F.encode("u", "UTF-8"), 256)
    if digest_all:
        rows = headed.select("id", "n", "len", "head", digest.alias("sha")).join(heads, ["len", "head"], "left")
    else:
        rows = headed.join(heads, ["len", "head"], "left").withColumn("sha", F.when(F.col("live"), digest))
    rows = cut(rows.select("id", "n", "sha", F.coalesce("live", F.lit(False)).alias("live")))
    # Level three: full hashes of the rows that level two leaves.
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").alias("id")))
    groups = rows.where("live").groupBy("sha").agg(F.count(F.lit(1)).alias("size"), first["id"].alias("keep")).where("size > 1")
    out = rows.join(groups, "sha", "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
