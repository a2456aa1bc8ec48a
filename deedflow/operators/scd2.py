"""Slowly changing history with disappearance tracking, and the dimension merges.

A merge takes the observed rows of some districts of one month (stage) and the history of that month, and gives the
new history of the month; the caller writes it as a new partition version. One full outer join on (key, dup_seq)
classifies everything, so the merge is one shuffle on the key, and running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_history(history: DataFrame, stage: DataFrame, parts: DataFrame, key: str, data: list[str], enrich: list[str] = ()) -> DataFrame:
    """The history after an observation.

    history: key, dup_seq, sgg_cd, attr_hash, *data, version, valid_from, valid_to, is_current, ingest_id,
    last_seen_ingest, last_seen_at, missing_since, missing_seq. stage: key, dup_seq, sgg_cd, attr_hash, *data.
    parts: sgg_cd, ingest_id, seen_at, fetch_seq of the districts observed; other districts stay as they are.
    """
    names = [key, "dup_seq", "sgg_cd", "attr_hash", *data]
    observed = F.broadcast(parts.select("sgg_cd", F.col("ingest_id").alias("p_ingest"), F.col("seen_at").alias("p_at"), F.col("fetch_seq").alias("p_seq")))
    closed = history.where("not is_current")
    old = history.where("is_current").join(observed, "sgg_cd", "left")
    new = stage.join(F.broadcast(parts.select("sgg_cd", F.col("ingest_id").alias("n_ingest"), F.col("seen_at").alias("n_at"))), "sgg_cd").select(F.col(key).alias("n_key"), F.col("dup_seq").alias("n_dup"), *(F.col(c).alias(f"n_{c}") for c in names[2:]), "n_ingest", "n_at")
    both = old.join(new, (F.col(key) == F.col("n_key")) & (F.col("dup_seq") == F.col("n_dup")), "full_outer")
    had, has = F.col(key).isNotNull(), F.col("n_key").isNotNull()
    same = had & has & (F.col("attr_hash") == F.col("n_attr_hash"))
    changed = had & has & (F.col("attr_hash") != F.col("n_attr_hash"))
    gone = had & ~has & F.col("p_ingest").isNotNull()

    def struct(**cols: Column) -> Column:
        return F.struct(*(cols[c].alias(c) for c in history.columns))

    kept = {c: F.col(c) for c in history.columns}
    refreshed = kept | {c: F.when(same, F.coalesce(F.col(f"n_{c}"), F.col(c))).otherwise(F.col(c)) for c in enrich}
    refreshed |= {
        "is_current": ~changed, "valid_to": F.when(changed, F.col("n_at")).otherwise(F.col("valid_to")),
        "last_seen_ingest": F.when(same, F.col("n_ingest")).otherwise(F.col("last_seen_ingest")), "last_seen_at": F.when(same, F.col("n_at")).otherwise(F.col("last_seen_at")),
        # The first time it was missed stays, until it is seen again.
        "missing_since": F.when(gone, F.coalesce("missing_since", "p_at")).when(~same, F.col("missing_since")), "missing_seq": F.when(gone, F.coalesce("missing_seq", "p_seq")).when(~same, F.col("missing_seq")),
    }
    types = {f.name: f.dataType for f in history.schema}
    null = lambda c: F.lit(None).cast(types[c])
    fresh = {c: null(c) for c in history.columns} | {key: F.col("n_key"), "dup_seq": F.col("n_dup")} | {c: F.col(f"n_{c}") for c in names[2:]}
    fresh |= {c: F.coalesce(F.col(f"n_{c}"), F.col(c)) for c in enrich}
    fresh |= {"version": F.coalesce(F.col("version") + 1, F.lit(1)).cast(types["version"]), "valid_from": F.col("n_at"), "is_current": F.lit(True), "ingest_id": F.col("n_ingest"), "last_seen_ingest": F.col("n_ingest"), "last_seen_at": F.col("n_at")}
    rows = F.filter(F.array(F.when(had, struct(**refreshed)), F.when(has & (~had | changed), struct(**fresh))), lambda r: r.isNotNull())
    return both.select(F.explode(rows).alias("r")).select("r.*").unionByName(closed)


def merge_complexes(dim: DataFrame, stage: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """The complex dimension after a stage. Values only improve: nulls are filled, first_seen only falls, and a serial
    is taken only if the stage has a single one. For leases give `trades`: complexes that have any keep their values."""
    lease = trades is not None
    found = stage.groupBy("complex_key").agg(
        *(F.min(c).alias(f"s_{c}") for c in ("sgg_cd", "umd_nm", "jibun", "apt_nm")), F.max("build_year").alias("s_build_year"),
        (F.lit(None).cast("boolean") if lease else F.bool_or("land_leasehold")).alias("s_land_leasehold"), F.min("deal_date").alias("s_first_seen"),
        F.when(F.count_distinct("apt_seq") == 1, F.min("apt_seq")).alias("s_apt_seq"),
    )
    if lease:
        found = found.join(trades.select("complex_key", F.lit(True).alias("traded")).distinct(), "complex_key", "left")
    both = dim.withColumn("known", F.lit(True)).join(found, "complex_key", "full_outer")
    closed = F.col("known").isNotNull() & F.coalesce("traded", F.lit(False)) if lease else F.lit(False)
    old = lambda c: F.coalesce(F.col(c), F.when(F.col("known").isNull(), F.col(f"s_{c}")))
    fill = lambda c: F.coalesce(F.col(c), F.when(~closed, F.col(f"s_{c}")))
    cols = {c: old(c) for c in ("sgg_cd", "umd_nm", "jibun", "apt_nm")} | {c: fill(c) for c in ("build_year", "land_leasehold", "apt_seq")} | {"first_seen": F.least("first_seen", "s_first_seen")}
    return both.select("complex_key", *(cols[c].alias(c) for c in dim.columns if c != "complex_key"))


def catch_up(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: complexes that a catch-up over all leases inserted, and those it fixed (M7)."""
    cols = [c for c in before.columns if c != "complex_key"]
    old = before.select("complex_key", F.struct(*cols).alias("old"))
    both = after.select("complex_key", F.struct(*cols).alias("new")).join(old, "complex_key", "left")
    return both.agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("fixed"))


def serial_conflicts(stage: DataFrame, dim: DataFrame) -> DataFrame:
    """One row: complexes with several serials, serials with several complexes, and complexes whose serial changed."""
    seen = stage.where(F.col("apt_seq").isNotNull())
    several = seen.groupBy("complex_key").agg(F.count_distinct("apt_seq").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("conflicts"))
    split = seen.groupBy("apt_seq").agg(F.count_distinct("complex_key").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("splits"))
    moved = seen.select("complex_key", "apt_seq").distinct().join(dim.select("complex_key", F.col("apt_seq").alias("held")), "complex_key").where("apt_seq <> held").agg(F.count_distinct("complex_key").alias("changed"))
    return several.crossJoin(split).crossJoin(moved)  # one row each


def stage_rows(bronze: DataFrame, loaded: DataFrame) -> DataFrame:
    """Bronze rows of the loads that are now in force, with this observation's time rather than the first fetch's."""
    now = F.broadcast(loaded.select("ingest_id", F.col("fetched_at").alias("seen_at"), F.col("fetch_count").alias("fetch_seq")))
    return bronze.join(now, "ingest_id")


def merge_regions(old: DataFrame, new: DataFrame, key: str = "region_cd") -> DataFrame:
    """All regions ever known; those in the new list are active and have its values."""
    cols = [c for c in new.columns if c != key]
    both = old.select(key, *(F.col(c).alias(f"o_{c}") for c in cols)).join(new.withColumn("active", F.lit(True)), key, "full_outer")
    return both.select(key, *(F.when(F.col("active"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in cols), F.coalesce("active", F.lit(False)).alias("active"))


def greatest_by_key(a: Column, b: Column) -> Column:
    """Key-wise maximum of two maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))
