"""Changes between two states, between versions, and their feed (V4, Q17, Q39, Q40)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_state(old: DataFrame, new: DataFrame, key: str, fields: list[str], missing: str = "missing_since") -> DataFrame:
    """key, change, changed_fields and the row image: added, removed (with the old row), missing, restored or updated."""
    a = old.select(F.col(key).alias("a_key"), *(F.col(c).alias(f"a_{c}") for c in fields))
    both = a.join(new.select(key, *fields), F.col("a_key") == F.col(key), "full_outer")
    names = F.filter(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    out = both.withColumn("d", names).withColumn("gone", F.col(key).isNull())
    alone = (F.size("d") == 1) & F.array_contains("d", missing) if missing in fields else F.lit(False)
    lost, back = (F.col(f"a_{missing}").isNull(), F.col(missing).isNull()) if missing in fields else (F.lit(False), F.lit(False))
    kind = F.when(F.col("a_key").isNull(), "added").when(F.col("gone"), "removed").when(alone & lost, "missing").when(alone & back, "restored").when(F.size("d") > 0, "updated")
    changed = F.when(kind == "updated", F.col("d")).otherwise(F.array().cast("array<string>"))
    image = [F.when(F.col("gone"), F.col(f"a_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return out.select(F.coalesce(key, "a_key").alias(key), kind.alias("change"), changed.alias("changed_fields"), *image).where("change is not null")


def apply_changes(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The state after a feed's changes: what diff_state of the two states has told, applied."""
    rows = changes.where("change <> 'removed'").select(*old.columns)
    return old.join(changes.select(key), key, "left_anti").unionByName(rows)


def version_diff(versions: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """key, version, changed: the tracked fields that differ from the version before; ["untracked"] if none does."""
    own = W.partitionBy(key).orderBy("version")
    before = F.lag(F.struct(*tracked)).over(own)
    names = F.filter(F.array(*(F.when(~F.col("was")[c].eqNullSafe(F.col(c)), F.lit(c)) for c in tracked)), lambda x: x.isNotNull())
    out = versions.withColumn("was", before)
    return out.select(key, "version", F.when(F.col("was").isNull(), F.array().cast("array<string>")).when(F.size(names) == 0, F.array(F.lit("untracked"))).otherwise(names).alias("changed"))


class FeedError(ValueError):
    """Why a feed cannot go on from a version: code, and for an expired one the oldest version that it can start from."""

    def __init__(self, code: str, oldest: str | None = None):
        super().__init__(code)
        self.code, self.oldest = code, oldest


def feed_window(versions: DataFrame, since: str, until: str | None, now: str, retention_days: int) -> tuple[str, DataFrame]:
    """(upper version, publishes after `since` up to it) of versions (version, published_at, publish_id, snapshot_baseline).

    VERSION_NOT_FOUND: since was never published. CHANGES_EXPIRED: it is older than the first baseline or than what is
    kept. INVALID_CURSOR: until is unknown or before since. Versions are ordered by time, then by name (Q39).
    """
    order, cutoff = F.struct("published_at", "version"), F.lit(now).cast("timestamp") - F.expr(f"interval {int(retention_days)} days")
    start = versions.where("snapshot_baseline").agg(F.min(order).alias("start"))
    seen = versions.crossJoin(start)  # one row
    usable = F.coalesce(F.col("start").isNotNull() & (order >= F.col("start")) & (F.col("published_at") >= cutoff), F.lit(False))
    is_ = lambda v: F.max(F.when(F.col("version") == v, order))
    facts = seen.agg(is_(since).alias("s"), F.max(F.when((F.col("version") == since) & usable, True)).alias("ok"), F.min(F.when(usable, order)).alias("oldest"), (is_(until) if until else F.max(order)).alias("u")).first()
    if facts["s"] is None:
        raise FeedError("VERSION_NOT_FOUND")
    if not facts["ok"]:
        raise FeedError("CHANGES_EXPIRED", facts["oldest"]["version"] if facts["oldest"] else None)
    if facts["u"] is None or tuple(facts["u"]) < tuple(facts["s"]):
        raise FeedError("INVALID_CURSOR")
    at = lambda v: F.struct(F.lit(v["published_at"]).alias("published_at"), F.lit(v["version"]).alias("version"))
    return facts["u"]["version"], versions.where((order > at(facts["s"])) & (order <= at(facts["u"])) & F.col("publish_id").isNotNull())


def feed_page(changes: DataFrame, publishes: DataFrame, after: tuple[int, str] | None, upto: int, size: int, key: str = "trade_id") -> DataFrame:
    """A page of changes in (ordinal, key) order after a place, up to a fixed publish, one row more than `size`."""
    rows = changes.join(F.broadcast(publishes.where(F.col("ordinal") <= upto)), "publish_id")
    if after is not None:
        rows = rows.where((F.col("ordinal") > after[0]) | ((F.col("ordinal") == after[0]) & (F.col(key) > after[1])))
    return rows.orderBy("ordinal", key).limit(size + 1)
