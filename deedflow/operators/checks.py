"""Checks as rows: data tests, reconciliation, post-merge checks and bronze validation.

Every check gives (check, failed, metric); a check passes when failed is 0. Checks are lazy and can be unioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, failed: Column, metric: Column | None = None) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.coalesce(failed, F.lit(0)).cast("long").alias("failed"), (metric if metric is not None else F.count(F.lit(1))).cast("double").alias("metric"))


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return _row(df.groupBy(*cols).count(), f"unique:{'+'.join(cols)}", F.count_if(F.col("count") > 1))


def not_null(df: DataFrame, col: str) -> DataFrame:
    return _row(df, f"not_null:{col}", F.count_if(F.col(col).isNull()))


def holds(df: DataFrame, rule: str) -> DataFrame:
    return _row(df, f"holds:{rule}", F.count_if(~F.coalesce(F.expr(rule), F.lit(True))))


def between(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return _row(df, f"between:{col}", F.count_if(~F.col(col).between(lo, hi)))


def accepted(df: DataFrame, col: str, values: list) -> DataFrame:
    return _row(df, f"accepted:{col}", F.count_if(~F.col(col).isin(values)))


def related(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    orphans = df.where(F.col(col).isNotNull()).join(other.select(F.col(other_col).alias("o")).distinct(), F.col(col) == F.col("o"), "left_anti")
    return _row(orphans, f"related:{col}", F.count(F.lit(1)))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconcile_rollup(districts: DataFrame, rollup: DataFrame, metrics: list[str], month: str = "deal_ym") -> DataFrame:
    """Rows of the rollup that differ from the sums of the districts: region_id, month, metric, expected, found."""
    sums = [F.sum(m).alias(m) for m in metrics]
    level = F.when(F.grouping("sido") == 1, "00").otherwise(F.col("sido"))
    expected = districts.withColumn("sido", F.substring("sgg_cd", 1, 2)).groupingSets([["sido", month], [month]], "sido", month).agg(level.alias("region_id"), *sums).drop("sido")
    # Both sides are small and keyed alike, so metrics are compared in one full join.
    both = expected.select("region_id", month, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("long"))))).alias("metric", "expected")).join(
        rollup.select("region_id", month, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("long"))))).alias("metric", "found")), ["region_id", month, "metric"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def post_merge(history: DataFrame, stage: DataFrame, parts: DataFrame, key: str, cancel_before: float | None = None) -> DataFrame:
    """Checks after a merge, of a month's history: one current row a key; in every observed district as many current rows
    that are not missing as the stage has; rows missing in three observations or more; duplicate groups; and the shift of
    the cancel ratio (at most 0.10). Only the first two block.

    parts: sgg_cd and fetch_seq of the districts observed, also of those whose stage is empty.
    """
    current = history.where("is_current")
    staged = stage.groupBy("sgg_cd").agg(F.count(F.lit(1)).alias("staged"))
    observed = current.where("missing_since is null").groupBy("sgg_cd").agg(F.count(F.lit(1)).alias("observed"))
    counts = parts.select("sgg_cd").distinct().join(staged, "sgg_cd", "left").join(observed, "sgg_cd", "left").na.fill(0, ["staged", "observed"])
    missed = current.where("missing_since is not null").join(parts.select("sgg_cd", "fetch_seq"), "sgg_cd", "left")
    # A row that was first missed in observation s has been missed fetch_seq - s + 1 times.
    checks = [
        _row(current.groupBy(key, "dup_seq").count(), "dup_current", F.count_if(F.col("count") > 1)),
        _row(counts, "stage_as_observed", F.count_if(F.col("staged") != F.col("observed"))),
        _row(missed, "missing_3_times", F.count_if(F.col("fetch_seq") - F.col("missing_seq") + 1 >= 3)),
        _row(stage, "duplicate_groups", F.lit(0), F.count_if(F.col("dup_seq") == 1)),
    ]
    if "is_cancelled" in history.columns:
        ratio = F.avg(F.col("is_cancelled").cast("int").cast("double"))
        shift = F.round(ratio - F.lit(cancel_before).cast("double"), 4)
        checks.append(_row(current, "cancel_shift", (F.abs(shift) > 0.10).cast("int"), shift))
    return report(*checks)


def validate_bronze(rows: DataFrame, previous: DataFrame, fields: list[str], required: list[str], row: str = "row") -> DataFrame:
    """(sgg_cd, check, failed, metric): unknown and missing fields, unreadable rows, wrong partition and changes of the
    number of rows, for every district loaded now or before.

    rows: typed rows with sgg_cd (expected), own_sgg, own_ym, deal_ym, the map `row`, missing and errors. previous:
    (sgg_cd, n) of the districts observed, n null where nothing was loaded before. Fewer than 70 % of 20 rows or more
    fail (row_drop), down to none at all; a change of more than 30 % either way only warns (row_change_warning).
    """
    unknown = F.size(F.array_except(F.map_keys(row), F.array(*map(F.lit, fields))))
    absent = F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys(row)))
    wrong = (F.col("own_sgg") != F.col("sgg_cd")) | (F.col("own_ym") != F.col("deal_ym"))
    agg = rows.groupBy("sgg_cd").agg(F.count(F.lit(1)).alias("n"), F.sum((unknown > 0).cast("int")).alias("unknown_fields"), F.sum(((absent > 0) | (F.size("missing") > 0)).cast("int")).alias("missing_fields"), F.sum((F.size("errors") > 0).cast("int")).alias("unreadable"), F.sum(F.coalesce(wrong, F.lit(True)).cast("int")).alias("wrong_partition"))
    names = ["unknown_fields", "missing_fields", "unreadable", "wrong_partition"]
    both = agg.join(previous.select("sgg_cd", F.col("n").alias("before")), "sgg_cd", "full_outer").na.fill(0, ["n", *names])
    drop = (F.col("before") >= 20) & (F.col("n") < F.col("before") * 0.7)
    change = F.round((F.col("n") - F.col("before")) / F.nullif(F.col("before"), F.lit(0)), 3)
    cols = {c: F.col(c) for c in names} | {"row_drop": F.coalesce(drop, F.lit(False)).cast("int"), "row_change_warning": F.coalesce(F.abs(change) > 0.3, F.lit(False)).cast("int")}
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), v.cast("long").alias("failed")) for k, v in cols.items()))
    return both.select("sgg_cd", F.explode(pairs).alias("c"), F.col("n").cast("double").alias("metric")).select("sgg_cd", "c.check", "c.failed", "metric")


def renamed(new: DataFrame, old: DataFrame, identity: list[str], name: str = "umd_nm") -> DataFrame:
    """Pairs (sgg_cd, old_nm, new_nm, n): equal contracts that now stand under another neighbourhood name."""
    was = old.select(*identity, F.col(name).alias("old_nm"))
    here = new.select(*identity, F.col(name).alias("new_nm")).join(was.withColumnRenamed("old_nm", "new_nm"), [*identity, "new_nm"], "left_anti")
    return here.join(was, identity).groupBy("sgg_cd", "old_nm", "new_nm").agg(F.count(F.lit(1)).alias("n"))


def version_mismatch(bronze: DataFrame, versions: dict[int, list[str]], row: str = "row") -> DataFrame:
    """One row: bronze rows with a field outside their schema version's."""
    allowed = F.coalesce(*(F.when(F.col("schema_ver") == v, F.array(*map(F.lit, f))) for v, f in versions.items()))
    bad = F.coalesce(F.size(F.array_except(F.map_keys(row), allowed)) > 0, F.lit(True))
    return _row(bronze, "row_matches_version", F.count_if(bad))


def quarantine_rate(outcomes: DataFrame, most: float = 0.2) -> DataFrame:
    """One row: whether a run quarantined a share of `most` or more of the partitions it asked for (V9)."""
    bad = F.count_if(F.col("status") == "QUARANTINED")
    share = bad / F.count(F.lit(1))
    return _row(outcomes, "quarantine_rate", (share >= most).cast("int"), share)


def verify_month(history: DataFrame, stage: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """The blocking checks of a month again, from stored tables, without merging."""
    return post_merge(history, stage, parts, key).where(F.col("check").isin("dup_current", "stage_as_observed"))
