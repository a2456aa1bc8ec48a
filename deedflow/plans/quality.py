"""Quality and operations queries (O1-O26) and display rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.operators.percentile import nearest_rank


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def version_counts(states: DataFrame) -> DataFrame:
    """Partitions by schema version; empty ones and loads without a recorded version stand apart (O1)."""
    bucket = F.when(F.col("rows_last") == 0, "empty").when(F.col("schema_ver").isNull(), "unrecorded").otherwise(F.col("schema_ver").cast("string"))
    return states.where("rows_last is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def failed_checks(checks: DataFrame, since: str) -> DataFrame:
    """Failed checks from a time on, with resolved: the same check of the same (nullable) partition passed later (O2).

    A window over the check's own rows replaces the correlated subquery.
    """
    own = W.partitionBy("asset", "check", "part")
    last_pass = F.max(F.when(F.col("passed"), F.col("at"))).over(own)
    return checks.withColumn("resolved", F.coalesce(last_pass > F.col("at"), F.lit(False))).where(~F.col("passed") & (F.col("at") >= F.lit(since).cast("timestamp")))


def grid(states: DataFrame) -> DataFrame:
    """Province x month x status counts (O3)."""
    return states.groupBy(F.substring("sgg_cd", 1, 2).alias("sido_cd"), "deal_ym", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_per(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key (O4); whole rows meet by a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *(c for c in rest if c != at))).alias("r")).select(*keys, "r.*")


def last_version_with(versions: DataFrame, month: str) -> DataFrame:
    """The last version whose partitions hold a month."""
    return versions.where(F.array_contains("partitions", month)).orderBy(F.desc("published_at"), F.desc("version")).limit(1)


def latency_distribution(latency: DataFrame, metric: str, lo: str, hi: str) -> DataFrame:
    return latency.where((F.col("metric") == metric) & F.col("observed_date").between(lo, hi) & (F.col("reason") == "")).groupBy("lag_days").agg(F.sum("n").alias("n"))


def latency_percentiles(latency: DataFrame, by: list[str]) -> DataFrame:
    return nearest_rank(latency.where("reason = ''"), by, "lag_days", "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def latency_bins(latency: DataFrame) -> DataFrame:
    """Counts in labelled day ranges."""
    d = F.col("lag_days")
    label = F.when(d <= 0, "0").when(d <= 3, "1-3").when(d <= 7, "4-7").when(d <= 14, "8-14").when(d <= 30, "15-30").otherwise("31+")
    return latency.where("reason = ''").groupBy("metric", label.alias("bin")).agg(F.sum("n").alias("n"))


def publish_lag(rows: DataFrame, by: list[str]) -> DataFrame:
    """Minutes from change to publish: discrete percentiles and counts within an hour, a day and beyond."""
    m = F.col("minutes")
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(m <= 60).alias("hour"), F.count_if((m > 60) & (m <= 1440)).alias("day"), F.count_if(m > 1440).alias("later"))
    return agg.join(nearest_rank(rows.withColumn("one", F.lit(1)), by, "minutes", "one", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("total"), by)


def lag_rows(publishes: DataFrame, changes: DataFrame) -> DataFrame:
    """Partitions changed since the previous publish of their month, with the minutes they waited."""
    span = publishes.withColumn("prev", F.lag("published_at").over(W.partitionBy("deal_ym").orderBy("published_at")))
    fresh = F.col("prev").isNull() | (F.col("changed_at") > F.col("prev"))
    return span.join(changes, "deal_ym").where((F.col("changed_at") <= F.col("published_at")) & fresh).withColumn("minutes", ((F.unix_timestamp("published_at") - F.unix_timestamp("changed_at")) / 60).cast("long")).drop("prev")


def error_groups(errors: DataFrame, by: list[str], code: str, samples: int = 8) -> DataFrame:
    """Groups of errors with their first codes in order (O9). Only the first codes are ever held: one row a different
    code, ranked, and cut before they are listed."""
    own = W.partitionBy(*by)
    codes = errors.groupBy(*by, code).agg(F.count(F.lit(1)).alias("c"))
    ranked = codes.withColumn("k", F.row_number().over(own.orderBy(code)))
    return ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col(code)))).alias("samples"))


def error_summary(usage: DataFrame, n: int = 20) -> DataFrame:
    """Routes with the most server errors."""
    return usage.where("status >= 500").groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at")).orderBy(F.desc("n"), "route", "status").limit(n)


def error_entries(sources: dict[str, DataFrame], cleared_at: str | None = None, source: str | None = None, text: str | None = None, cleared: bool = True) -> DataFrame:
    """Entries (source, at, text, cleared) of sources (at, text), cleared being what is older than a marker.

    Only one source, only texts that hold a text in any case, or only what is not cleared, if asked.
    """
    out = None
    for name, df in sources.items():
        if source in (None, name):
            part = df.select(F.lit(name).alias("source"), "at", redact(F.col("text")).alias("text"))
            out = part if out is None else out.unionByName(part)
    old = F.col("at") <= F.lit(cleared_at).cast("timestamp") if cleared_at else F.lit(False)
    out = out.withColumn("cleared", old)
    if text:
        out = out.where(F.instr(F.lower("text"), text.lower()) > 0)
    return out if cleared else out.where(~F.col("cleared"))


def error_log(entries: DataFrame, limit: int) -> DataFrame:
    """The newest entries first, each with the number of all of them and whether the list was cut."""
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    return entries.orderBy(F.desc("at"), "source", "text").limit(limit).crossJoin(total).withColumn("truncated", F.col("total") > limit)  # total is one row


def error_counts(entries: DataFrame) -> DataFrame:
    """Entries by source, and of those the ones that are not cleared."""
    return entries.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("cleared")).alias("open"))


def resolved_runs(runs: DataFrame) -> DataFrame:
    """Failed runs, with resolved: a later success of the same job and partition."""
    own = W.partitionBy("job", "part")
    done = F.max(F.when(F.col("ok"), F.col("at"))).over(own)
    return runs.withColumn("resolved", F.coalesce(done > F.col("at"), F.lit(False))).where(~F.col("ok"))


def backfill_days(remaining: int, share: int) -> int | None:
    """Whole days that the remaining calls take."""
    return -(-remaining // share) if share > 0 else None


def usage_by(usage: DataFrame, unit: str, zone: str = "Asia/Seoul") -> DataFrame:
    """Calls, rows, server errors and the approximate 95 % latency by client and local month or day."""
    period = F.date_format(F.from_utc_timestamp("at", zone), {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])
    return usage.groupBy("client_id", period.alias("period")).agg(F.count(F.lit(1)).alias("calls"), F.sum("rows").alias("rows"), F.count_if(F.col("status") >= 500).alias("errors"), F.percentile_approx("latency", 0.95).alias("p95_latency"))


def usage_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two monthly counts side by side."""
    return a.join(b, ["client_id", "period"], "full_outer").na.fill(0)


def complete_months(states: DataFrame, leaves: int, least: float = 0.9) -> DataFrame:
    """Months whose merged partitions cover enough of the active districts."""
    return states.groupBy("deal_ym").agg((F.count_if(F.col("status") == "MERGED") / F.lit(float(leaves))).alias("coverage")).where(F.col("coverage") >= least)


def due(states: DataFrame, now: str) -> DataFrame:
    """Partitions to fetch now, listed by month and status (O17); a month has at most one entry a district."""
    rows = states.where(F.col("status").isin("PENDING", "RETRY", "MERGED", "LOADED") & (F.col("next_due_at") <= F.lit(now).cast("timestamp")))
    return rows.groupBy("deal_ym", "status").agg(F.array_sort(F.collect_list("sgg_cd")).alias("sgg"))


def missing_cells(districts: DataFrame, months: DataFrame, states: DataFrame) -> DataFrame:
    """District x month pairs without a state row (O18). The months are a short calendar, so each district carries it."""
    spans = months.agg(F.sort_array(F.collect_set("deal_ym")).alias("ms"))
    return districts.crossJoin(F.broadcast(spans)).select("sgg_cd", F.explode("ms").alias("deal_ym")).join(states.select("sgg_cd", "deal_ym"), ["sgg_cd", "deal_ym"], "left_anti")


def next_due(month: Column, now: Column) -> Column:
    """The next fetch: after 1, 30 or 90 days by the month's age."""
    age = F.year(now) * 12 + F.month(now) - (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 5, 2).cast("int"))
    return now + F.make_interval(days=F.when(age < 3, 1).when(age < 12, 30).otherwise(90))


ATTEMPTS = 3


def transitions(states: DataFrame, observed: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """States after observations (O19). observed: source, sgg_cd, deal_ym, kind, at, error, and for loads rows, sha,
    ingest_id and schema_ver.

    loaded sets the new load; unchanged goes back to LOADED or MERGED by what was last merged; both count the fetch and
    clear the attempts. failed counts the attempt, puts the next one off by half an hour for each, and quarantines at
    the limit; rejected (a failed check, or an answer that a retry cannot better) quarantines at once. released (out of
    budget, source closed) and interrupted retry without counting the attempt; after interrupted the next fetch is due
    an hour later. merged marks the last load as merged.
    """
    keys = ["source", "sgg_cd", "deal_ym"]
    o = observed.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("kind", "at", "error", "rows", "sha", "ingest_id", "schema_ver")))
    df = states.join(o, keys, "left")
    kind, at = F.col("o_kind"), F.col("o_at")
    loaded, seen, lost = kind == "loaded", kind.isin("loaded", "unchanged"), kind.isin("failed", "rejected")
    tries = F.when(seen, 0).when(lost, F.col("attempts") + 1).otherwise(F.col("attempts"))
    same = F.col("last_ingest_id").eqNullSafe(F.col("merged_ingest_id"))
    status = (
        F.when(loaded, "LOADED").when(kind == "unchanged", F.when(same, "MERGED").otherwise("LOADED")).when((kind == "rejected") | ((kind == "failed") & (tries >= attempts)), "QUARANTINED")
        .when(kind.isin("failed", "released", "interrupted"), "RETRY").when(kind == "merged", "MERGED").otherwise(F.col("status"))
    )
    of = lambda name, when, value: F.when(when, value).otherwise(F.col(name))
    new = {
        "status": status, "attempts": tries, "rows_prev": of("rows_prev", loaded, F.col("rows_last")), "rows_last": of("rows_last", loaded, F.col("o_rows")),
        "payload_sha256": of("payload_sha256", loaded, F.col("o_sha")), "last_ingest_id": of("last_ingest_id", loaded, F.col("o_ingest_id")), "schema_ver": of("schema_ver", loaded, F.col("o_schema_ver")),
        "merged_ingest_id": of("merged_ingest_id", kind == "merged", F.col("last_ingest_id")), "last_fetched_at": of("last_fetched_at", seen, at), "last_changed_at": of("last_changed_at", loaded, at),
        "fetch_count": F.col("fetch_count") + F.when(seen, 1).otherwise(0), "last_error": F.when(seen, F.lit(None)).when(lost | kind.isin("released", "interrupted"), F.substring("o_error", 1, 500)).otherwise(F.col("last_error")),
        "next_due_at": F.when(seen, next_due(F.col("deal_ym"), at)).when(lost, at + F.make_interval(mins=30 * tries)).when(kind == "interrupted", at + F.expr("interval 1 hour")).otherwise(F.col("next_due_at")),
    }
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in states.columns))


def gauges(states: DataFrame, now: str) -> DataFrame:
    """Freshness in seconds, partitions by status, failures."""
    fresh = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("last_changed_at"))
    return states.groupBy("source").agg(fresh.alias("freshness_s"), F.max("last_changed_at").alias("data_as_of"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "QUARANTINED").alias("quarantined"), F.count(F.lit(1)).alias("partitions"))


def budget_day(calls: DataFrame, day: str) -> DataFrame:
    """One row: the calls of a day by priority and in all (O22). calls: day, priority, calls."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("priority") == p, F.col("calls"))), F.lit(0)).alias(p)
    return calls.where(F.col("day") == F.lit(day).cast("date")).agg(*(of(p) for p in ("incremental", "recheck", "backfill")), F.coalesce(F.sum("calls"), F.lit(0)).alias("used"))


def month_counts(months: DataFrame) -> DataFrame:
    """One row: months that wait for a publish and months that are published (O22). months: merged_at, published_at."""
    waits = F.col("published_at").isNull() | (F.col("merged_at") > F.col("published_at"))
    return months.where("merged_at is not null").agg(F.count_if(waits).alias("pending"), F.count_if(~waits).alias("published"))


def last_version(versions: DataFrame) -> DataFrame:
    """The version published last."""
    return versions.orderBy(F.desc("published_at"), F.desc("version")).limit(1)


def last_month_file(files: DataFrame, versions: DataFrame, month: str) -> DataFrame:
    """One row: the file recorded last for a month (O23); null if there is none."""
    own = files.where(F.col("deal_ym") == month).join(versions.select("publish_id", "published_at", "version"), "publish_id")
    return own.agg(F.max_by("object_key", F.struct("published_at", "version")).alias("object_key"))


def recheck_pending(states: DataFrame, now: str) -> DataFrame:
    """At most one row: whether a month of age 3 to 12 is due."""
    age = F.year(F.lit(now).cast("date")) * 12 + F.month(F.lit(now).cast("date")) - (F.substring("deal_ym", 1, 4).cast("int") * 12 + F.substring("deal_ym", 5, 2).cast("int"))
    return states.where((age >= 3) & (age < 12) & (F.col("next_due_at") <= F.lit(now).cast("timestamp"))).limit(1)


# Names of fields whose values are credentials.
_CREDENTIALS = r"service_?key|api[-_]?key|crtfc_key|access[-_]?key(?:[-_]?id)?|secret(?:[-_]?access)?(?:[-_]?key)?|private[-_]?key|password|passwd|pwd|token|credentials?|signature"
_REDACTIONS = (
    # issued keys, by their form
    (r"\b([a-z]{2,8}_live_)[0-9A-Za-z]{12}\.[A-Za-z0-9_-]{20,}", "$1***"),
    # the password in the user part of an address
    (r"(?i)\b([a-z][a-z0-9+.-]*://[^:/@\s]*):[^@\s]+@", "$1:***@"),
    # headers, with the scheme before the value
    (r"""(?i)\b((?:authorization|x-api-key)["']?\s*[:=]\s*["']?)(?:(?:bearer|basic|token)\s+)?[^\s"',}]+""", "$1***"),
    # name=value, "name": "value", also where the name has a prefix; and a field that is called key
    (rf"""(?i)((?<![\w.-])(?:[\w.-]*?(?:{_CREDENTIALS})|key)["']?\s*[:=]\s*["']?)(?!\*\*\*)[^\s"',}}&]+""", "$1***"),
)


def redact(c: Column) -> Column:
    """Error text without credentials (O26); null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in _REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def overlap_meta(errors: DataFrame) -> DataFrame:
    """Interpolated percentiles of boundary errors."""
    of = lambda p: F.percentile("area_error", F.lit(p))
    return errors.agg(F.count(F.lit(1)).alias("n"), of(0.5).alias("p50"), of(0.95).alias("p95"), F.max("area_error").alias("worst"))


def quantile_edges(df: DataFrame, value: str, k: int) -> DataFrame:
    """Different edges v[floor(i n / k)], i in 1..k-1; none if there are fewer than k values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    every = W.partitionBy(F.lit(0))
    run = counts.withColumn("end", F.sum("c").over(every.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(every))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k))
    return run.where(F.col("n") >= k).withColumn("r", F.explode(ranks)).where((F.col("end") - F.col("c") <= F.col("r")) & (F.col("r") < F.col("end"))).select(F.col("v").alias("edge")).distinct()


def yoy_class(c: Column, edges: tuple[float, ...] = (-10.0, -5.0, -1.0, 1.0, 5.0, 10.0)) -> Column:
    """Fixed divergent classes of a yearly change."""
    out = F.when(c.isNull(), None)
    for k, e in enumerate(edges):
        out = out.when(c < e, k)
    return out.otherwise(len(edges))


def rebased(a: DataFrame, b: DataFrame, period: str = "deal_ym") -> DataFrame:
    """Two series (period, value) set to 100 at their first common month."""
    both = a.select(period, F.col("value").alias("a")).join(b.select(period, F.col("value").alias("b")), period)
    base = both.agg(F.min_by(F.struct("a", "b"), period).alias("base"))
    return both.join(F.broadcast(base)).select(period, *(F.try_divide(F.col(x) * 100.0, F.nullif(F.col(f"base.{x}"), F.lit(0.0))).alias(x) for x in "ab"))


def completion(states: DataFrame, by: list[str]) -> DataFrame:
    """Merged share in percent."""
    return states.groupBy(*by).agg(F.round(F.count_if(F.col("status") == "MERGED") * 100.0 / F.count(F.lit(1)), 1).alias("pct"))


def region_search(regions: DataFrame, text: str, n: int = 10) -> DataFrame:
    """Regions by name: prefix, then word prefix, then inside, then in the full name; initials match too."""
    from deedflow.functions.values import initials

    q = re.sub(r"\s+", "", text.lower())
    name, full = F.lower("sgg_nm"), F.lower("full_nm")
    rank = F.when(name.startswith(q), 0).when(F.array_max(F.transform(F.split(name, r"\s+"), lambda w: w.startswith(q))), 1).when(F.contains(name, F.lit(q)) | F.contains(initials(name), F.lit(q)), 2).when(F.contains(F.replace(full, F.lit(" "), F.lit("")), F.lit(q)), 3)
    return regions.withColumn("rank", rank).where("rank is not null").orderBy("rank", "sgg_cd").limit(n)
