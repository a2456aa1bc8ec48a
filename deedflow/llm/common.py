"""What the training-data operators share: reading, shared storage, checked broadcasts, batch helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it is measured to be no larger than this many rows.
BROADCAST_ROWS = 200_000
#: Rows and bytes of a text column that a Python worker handles at once; one longer text is handled alone. The whole batch
#: that comes over from the JVM is bounded by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set).
TEXT_ROWS = 512
TEXT_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is configured (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="deedflow-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, where every executor can read it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, parts: int = 8) -> DataFrame:
    """cut() for results of few rows, which are dealt to a few files after they are computed."""
    return cut(df.repartition(parts))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most `rows` rows; else df, joined by shuffle.

    df should be cheap to count: a checkpointed or tiny table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def integer_ids(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows with column id as long integers, and (id, name) of what they stand for; no names if the ids are integers.

    Other ids are numbered in the order in which Spark sorts them; null stays null.
    """
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        return rows.withColumn("id", F.col("id").cast("long")), None
    names = cut(rows.where("id is not null").select(F.col("id").alias("name")).distinct().sort("name").withColumn("id", F.monotonically_increasing_id()))
    known = names.select(F.col("name").alias("known"), F.col("id").alias("number"))
    rest = [c for c in rows.columns if c != "id"]
    return rows.join(known, rows["id"] == known["known"], "left").select(F.col("number").alias("id"), *rest), names


def slices(b: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """b in slices of at most `rows` rows and, unless a single row is larger, TEXT_BYTES bytes."""
    if b.num_rows and b.nbytes <= TEXT_BYTES:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))
        return
    at = 0
    while at < b.num_rows:
        n = min(rows, b.num_rows - at)
        while n > 1 and b.slice(at, n).nbytes > TEXT_BYTES:
            n = (n + 1) // 2
        yield b.slice(at, n)
        at += n


def map_text(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = TEXT_ROWS) -> DataFrame:
    """mapInArrow; fn sees slices of at most `rows` rows and about TEXT_BYTES bytes, so long texts never meet in one large batch."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(part for b in batches for part in slices(b, rows))

    return df.mapInArrow(sliced, schema)
