"""Streaming: observations merged into history, usage sinks, and windows over events.

Late data is never dropped: the history merge is keyed state in tables, so there is no watermark on it. Observations
are applied in arrival order, one micro-batch at a time, and a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deedflow.operators.scd2 import merge_history
from deedflow.sources.tables import Table


def merge_stream(observations: DataFrame, table: Table, name: str, key: str, data: list[str], empty: DataFrame, checkpoint: str, enrich: list[str] = (), once: bool = True) -> StreamingQuery:
    """Merges a stream of stage rows (with deal_ym, ingest_id, seen_at, fetch_seq) into the history table, month by month.

    A batch may hold several observations of a district. They are merged in rounds: the first observation of every
    district, then the second, and so on; a round merges all districts of a month at once and commits its months together.
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            loads = batch.select("deal_ym", "sgg_cd", "seen_at").distinct()
            loads = loads.withColumn("round", F.row_number().over(W.partitionBy("deal_ym", "sgg_cd").orderBy("seen_at"))).persist()
            # The loop is over rounds and months, not over loads or rows.
            rounds: dict[int, list[str]] = {}
            for r in loads.select("round", "deal_ym").distinct().orderBy("round", "deal_ym").collect():
                rounds.setdefault(r["round"], []).append(r["deal_ym"])
            for no, months in sorted(rounds.items()):
                staged = {}
                for month in months:
                    own = loads.where((F.col("round") == no) & (F.col("deal_ym") == month)).select("sgg_cd", "seen_at")
                    rows = batch.where(F.col("deal_ym") == month).join(own, ["sgg_cd", "seen_at"], "left_semi").select(batch.columns)
                    parts = rows.select("sgg_cd", "ingest_id", "seen_at", "fetch_seq").distinct()
                    held = table.read(name, [month])
                    merged = merge_history(held if held is not None else empty, rows.where(F.col(key).isNotNull()), parts, key, data, enrich)
                    staged[name, month] = table.stage(name, month, merged)
                table.commit(staged)
            loads.unpersist()
        finally:
            batch.unpersist()

    writer = observations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")).start()


def usage_sink(usage: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, most: int = 1000, queue: int = 50_000, dropped: Callable[[int], None] = lambda n: None) -> StreamingQuery:
    """Usage events in micro-batches of a second, written in parts of at most `most` rows. Of a batch that overflows the
    queue the rows beyond it are dropped and their number is told: records of use must not hold up what they record."""

    def apply(batch: DataFrame, no: int) -> None:
        batch = batch.persist()
        try:
            n = batch.count()
            if n > queue:
                dropped(n - queue)
            if n:
                kept = min(n, queue)
                write(batch.limit(queue).repartition(-(-kept // most)), no)
        finally:
            batch.unpersist()

    writer = usage.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def due_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New observation files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def windowed_counts(events: DataFrame, width: str, at: str = "ts", by: list[str] = (), late: str | None = None) -> DataFrame:
    """An extra over event logs: counts in tumbling windows; with `late` as a watermark it also runs on streams."""
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
