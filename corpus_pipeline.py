"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark passages, source weights.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each
stage's rows to the shared folder and hands the next stage what it reads back. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedflow.llm.common import cut, shared_dir, small, table
from deedflow.llm.decontaminate import IDS, decontaminate
from deedflow.llm.line_dedup import line_dedup
from deedflow.llm.mixing import mix, taken
from deedflow.llm.quality import accepted, learn
from deedflow.llm.simhash import RADIUS, near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns, whatever their names. Null and empty texts are judged
    by the bias alone; rows that repeat an id are judged each by its text; without labels none is accepted (score 0.5); an
    empty table gives no rows."""
    return accepted(docs, learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text. Null and empty texts stay as
    they are, a null source is one of its own, rows that repeat an id are pages of their own, an empty table gives no rows."""
    kept = line_dedup(docs, host="source", carry=True)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the ids of ids (doc_id). Rows with a null id stay. Columns may have any names."""
    gone = small(cut(ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()), IDS)
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id. Near copies are what op8 joins, by its fingerprints and
    grid, and pairs of a shingle similarity of 0.8. Rows that repeat an id are one document and stay or go together; rows
    without an id stay; null and empty texts are equal to each other; ids may be of any type."""
    return _without(docs, near_copies(docs, radius=RADIUS).where("doc_id <> component_id").select("doc_id"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item. An id goes with all its rows; rows without an id
    stay; null and empty texts share nothing; without items all stay."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken. Null and empty texts have size 0 and give
    nothing; every row counts as a document; an empty table gives no rows."""
    return taken(mix(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("mixture", mixture)]

#: The stages train a model and follow links of any length: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:  # no later stage reads the rows before these
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
