"""Serving queries over the marts: distributions, bands, pages, series, ratios, versions to files (Q1-Q43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.functions.values import AREA_EDGES, FLOOR_EDGES, band, month_no, month_text, nice_width, pct_change
from deedflow.operators.percentile import exact_percentiles
from deedflow.plans.marts import priced

MIN_CHANGE = 30
WINDOW_MONTHS = 12
MIN_RATIO = 5


def month_bounds(marts: DataFrame) -> DataFrame:
    return marts.agg(F.min("deal_ym").alias("lo"), F.max("deal_ym").alias("hi"))


def region_list(marts: DataFrame, columns: list[str]) -> DataFrame:
    """The regions that the marts know, by code (Q5)."""
    return marts.select(*columns).distinct().orderBy(columns[0])


def latest_month(rows: DataFrame, day: str) -> DataFrame:
    """The month of the last contract (Q38)."""
    return rows.agg(F.date_format(F.max(day), "yyyyMM").alias("latest"))


def compared_months(marts: DataFrame, ym: str) -> DataFrame:
    """Rows of a month, the month before and the same month a year before (Q2)."""
    no = int(ym[:4]) * 12 + int(ym[4:])
    months = [f"{(n - 1) // 12}{(n - 1) % 12 + 1:02d}" for n in (no, no - 1, no - 12)]
    return marts.where(F.col("deal_ym").isin(months))


def range_or_month(marts: DataFrame, lo: str, hi: str, other: str) -> DataFrame:
    return marts.where(F.col("deal_ym").between(lo, hi) | (F.col("deal_ym") == other))


def last_points(series: DataFrame, key: str, n: int, period: str = "deal_ym") -> DataFrame:
    """The last n periods of every key (Q4)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(period).desc()))
    return series.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def month_series(marts: DataFrame, sgg: str, lo: str, hi: str) -> DataFrame:
    return marts.where((F.col("sgg_cd") == sgg) & F.col("deal_ym").between(lo, hi)).orderBy("deal_ym")


def price_stats(serving: DataFrame, by: list[str], value: str = "ppm2", sample: Column | None = None) -> DataFrame:
    """Counts and the 5, 25, 50, 75 and 95 % percentiles of the priced sample (Q7, Q28)."""
    sample = priced(serving) if sample is None else sample
    cancelled = F.count_if("is_cancelled") if "is_cancelled" in serving.columns else F.lit(0)
    counts = serving.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cancelled.cast("long").alias("cancelled"), F.count_if(sample).alias("priced"))
    pct = exact_percentiles(serving.where(sample), by, value, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).drop("n")
    return counts.join(pct, by, "left")


def histogram(serving: DataFrame, by: list[str], value: str = "ppm2", sample: Column | None = None) -> DataFrame:
    """by, bin, n: bins of a round width that cuts the 5-95 % range into at most 16 (Q8, Q9)."""
    sample = priced(serving) if sample is None else sample
    rows = serving.where(sample)
    width = exact_percentiles(rows, by, value, {"p05": 0.05, "p95": 0.95}).select(*by, nice_width(F.col("p05"), F.col("p95")).alias("width"))
    return rows.join(width, by).groupBy(*by, (F.floor(F.col(value) / F.col("width")) * F.col("width")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def by_area(serving: DataFrame, by: list[str], value: str = "ppm2", sample: Column | None = None) -> DataFrame:
    """Sample size and median of each area band, upper edges outside (Q10)."""
    rows = serving.where(priced(serving) if sample is None else sample).withColumn("band", band(F.col("area_m2"), AREA_EDGES, False))
    return exact_percentiles(rows, [*by, "band"], value, {"median": 0.5})


def by_floor(serving: DataFrame, by: list[str]) -> DataFrame:
    """Trades and mean price of each floor band, upper edges inside; area 0 counts, unknown floors do not (Q11)."""
    rows = serving.where(~F.col("is_cancelled") & F.col("floor").isNotNull()).withColumn("band", band(F.col("floor"), FLOOR_EDGES, True))
    return exact_percentiles(rows.withColumn("price", F.col("price_manwon").cast("double")), [*by, "band"], "price", {"median": 0.5})


def points(serving: DataFrame, where: Column, n: int) -> DataFrame:
    """The first n priced trades by date, ties by id (Q12)."""
    return serving.where(where & priced(serving)).orderBy("deal_date", "trade_id").limit(n).select("trade_id", "deal_date", "area_m2", "ppm2")


def top_complexes(serving: DataFrame, where: Column, n: int) -> DataFrame:
    """Complexes by number of valid trades, with the median, and the last trade by (date, id) (Q13)."""
    rows = serving.where(where & ~F.col("is_cancelled"))
    last = F.max_by("price_manwon", F.struct("deal_date", "trade_id"))
    agg = rows.groupBy("complex_key").agg(F.count(F.lit(1)).alias("n"), F.max("deal_date").alias("last_date"), last.alias("last_price"))
    med = exact_percentiles(rows.where(priced(rows)), ["complex_key"], "ppm2", {"median": 0.5}).drop("n")
    return agg.join(med, "complex_key", "left").orderBy(F.desc("n"), F.desc_nulls_last("median"), "complex_key").limit(n)


def page(df: DataFrame, where: Column, after: tuple | None, size: int, key: str = "trade_id") -> DataFrame:
    """Latest first by (date, key), from a place on; one row more than size tells that there is a next page (Q14, Q29)."""
    if after is not None:
        where = where & (F.struct("deal_date", key) < F.struct(F.lit(after[0]).cast("date"), F.lit(after[1])))
        # What the order of dates implies, said so that the scan can use it: months choose directories, dates row groups.
        where = where & (F.col("deal_date") <= F.lit(after[0]).cast("date"))
        if "deal_ym" in df.columns:
            where = where & (F.col("deal_ym") <= after[0][:4] + after[0][5:7])
    return df.where(where).orderBy(F.desc("deal_date"), F.desc(key)).limit(size + 1)


def trade_summary(serving: DataFrame, by: list[str]) -> DataFrame:
    """Counts, the median price of valid trades, and the median ppm2 of the priced sample (Q15)."""
    counts = serving.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_cancelled").alias("cancelled"))
    price = exact_percentiles(serving.where(~F.col("is_cancelled")).withColumn("p", F.col("price_manwon").cast("double")), by, "p", {"median_price": 0.5}).drop("n")
    ppm2 = exact_percentiles(serving.where(priced(serving)), by, "ppm2", {"median_ppm2": 0.5}).drop("n")
    return counts.join(price, by, "left").join(ppm2, by, "left")


def rent_summary(rents: DataFrame, by: list[str]) -> DataFrame:
    """Leases, those without a monthly rent, the median deposit of these and the median rent of the others (Q29)."""
    counts = rents.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_jeonse").alias("jeonse"))
    of = lambda where, c, name: exact_percentiles(rents.where(where).withColumn("x", F.col(c).cast("double")), by, "x", {name: 0.5}).drop("n")
    return counts.join(of("is_jeonse", "deposit_manwon", "median_deposit"), by, "left").join(of("not is_jeonse", "monthly_rent_manwon", "median_rent"), by, "left")


def versions_of(history: DataFrame, ident: str, month: str, key: str = "trade_id") -> DataFrame:
    """The history of an id, from its own month partition (Q16, Q30)."""
    return history.where((F.col("deal_ym") == month) & (F.col(key) == ident)).orderBy("version")


def search(dim: DataFrame, text: str, n: int = 15) -> DataFrame:
    """Complexes with the text in name or neighbourhood, any case, most traded first (Q19)."""
    hit = F.lit(False)
    for c in ("apt_nm", "umd_nm"):
        hit = hit | (F.instr(F.lower(c), text.lower()) > 0)
    return dim.where(hit).orderBy(F.desc("trades"), "complex_key").limit(n)


def series_arrays(series: DataFrame, key: str, value: str, period: str = "deal_ym") -> DataFrame:
    """Each key with its periods and values in order (Q20); a series has one row a period."""
    s = F.array_sort(F.collect_list(F.struct(F.col(period).alias("period"), F.col(value).alias("value"))))
    return series.groupBy(key).agg(s.alias("s")).select(key, F.transform("s", lambda x: x["period"]).alias("periods"), F.transform("s", lambda x: x["value"]).alias("values"))


def with_changes(marts: DataFrame, key: str, metrics: dict[str, int], gate: str | None = None) -> DataFrame:
    """marts with <metric>_mom and <metric>_yoy: the change against exactly 1 and 12 months before.

    A metric's number is the least sample that both rows need in column `gate` for a yearly change (0: none).
    """
    own = W.partitionBy(key).orderBy("no")
    df = marts.withColumn("no", month_no(F.col("deal_ym")))
    for name, months in (("mom", 1), ("yoy", 12)):
        # A range frame finds the month itself, so gaps never shift the comparison.
        then = F.first(F.struct(*metrics, *([gate] if gate else []))).over(own.rangeBetween(-months, -months))
        df = df.withColumn("then", then)
        for m, least in metrics.items():
            change = pct_change(F.col(m), F.col(f"then.{m}"))
            if gate and least and name == "yoy":
                change = F.when((F.col(gate) >= least) & (F.col(f"then.{gate}") >= least), change)
            df = df.withColumn(f"{m}_{name}", change)
    return df.drop("then", "no")


def district_summary(region_month: DataFrame, ym: str) -> DataFrame:
    """District rows of a month with cancel rate and changes (Q22)."""
    changed = with_changes(region_month, "sgg_cd", {"median_ppm2": MIN_CHANGE, "trades": 0}, "priced")
    return changed.where(F.col("deal_ym") == ym).withColumn("cancel_rate", F.try_divide(F.col("cancelled").cast("double"), F.col("reported"))).drop("median_ppm2_mom")


def region_spark(rollup: DataFrame, ym: str, months: int = 12) -> DataFrame:
    """Each region's last months up to ym as ordered arrays (Q23)."""
    no = int(ym[:4]) * 12 + int(ym[4:])
    rows = rollup.where(month_no(F.col("deal_ym")).between(no - months + 1, no))
    s = F.array_sort(F.collect_list(F.struct("deal_ym", "trades")))
    return rows.groupBy("region_id").agg(s.alias("s")).select("region_id", F.transform("s", lambda x: x["deal_ym"]).alias("months"), F.transform("s", lambda x: x["trades"]).alias("trades"))


def index_summary(index: DataFrame, today: str, settle_days: int = 30, spark_months: int = 24, key: str = "region_id") -> DataFrame:
    """Each region's last month and its last confirmed month of an index, with the changes against the month and the year
    before each, and its last points in order (Q21). A month is confirmed when its end lies more than settle_days back."""
    confirmed = F.date_add(F.last_day(F.to_date(F.concat("deal_ym", F.lit("01")), "yyyyMMdd")), settle_days) < F.lit(today).cast("date")
    rows = with_changes(index.select(key, "deal_ym", "value"), key, {"value": 0}).withColumn("confirmed", confirmed)
    point = F.struct("deal_ym", "value", F.col("value_mom").alias("mom"), F.col("value_yoy").alias("yoy"))
    own = W.partitionBy(key).orderBy(F.desc("deal_ym"))
    rows = rows.withColumn("rank", F.row_number().over(own))
    last = F.array_sort(F.collect_list(F.when(F.col("rank") <= spark_months, F.struct("deal_ym", "value"))))
    return rows.groupBy(key).agg(F.max_by(point, "deal_ym").alias("latest"), F.max_by(point, F.when(F.col("confirmed"), F.col("deal_ym"))).alias("settled"), last.alias("points"))


def ticker(index: DataFrame, today: str, settle_days: int = 30, key: str = "region_id") -> DataFrame:
    """Each region's last confirmed value, and its change in percent only if the month before is confirmed too and stands
    right before it (Q26)."""
    confirmed = F.date_add(F.last_day(F.to_date(F.concat("deal_ym", F.lit("01")), "yyyyMMdd")), settle_days) < F.lit(today).cast("date")
    own = W.partitionBy(key).orderBy("deal_ym")
    rows = index.where(confirmed).withColumn("no", month_no(F.col("deal_ym")))
    rows = rows.withColumn("was", F.lag("value").over(own)).withColumn("gap", F.col("no") - F.lag("no").over(own))
    change = F.when(F.col("gap") == 1, pct_change(F.col("value"), F.col("was")))
    return rows.withColumn("change", change).groupBy(key).agg(F.max_by(F.struct("deal_ym", "value", "change"), "deal_ym").alias("q")).select(key, "q.*")


def ranking(summary: DataFrame, metric: str, descending: bool, n: int = 10) -> DataFrame:
    """The first n districts by a metric, ties by code (Q24)."""
    order = F.desc(metric) if descending else F.asc(metric)
    return summary.where(F.col(metric).isNotNull()).orderBy(order, "sgg_cd").limit(n).select("sgg_cd", metric)


def default_month(marts: DataFrame, today: str, settle_days: int = 30, within: int = 6) -> DataFrame:
    """The latest of the last `within` calendar months that has settled: month end plus settle_days is past; else the
    latest (Q25)."""
    months = marts.select("deal_ym").distinct()
    last = months.agg(F.max("deal_ym").alias("last"))
    months = months.crossJoin(last).where(month_no(F.col("last")) - month_no(F.col("deal_ym")) < within)  # last is one row
    settled = F.date_add(F.last_day(F.to_date(F.concat("deal_ym", F.lit("01")), "yyyyMMdd")), settle_days) < F.lit(today).cast("date")
    return months.agg(F.coalesce(F.max(F.when(settled, F.col("deal_ym"))), F.max("deal_ym")).alias("month"))


def calendar(spark, lo: str, hi: str) -> DataFrame:
    """Months lo..hi."""
    a, b = (int(x[:4]) * 12 + int(x[4:]) for x in (lo, hi))
    return spark.range(a, b + 1).select(month_text(F.col("id")).alias("deal_ym"))


def calendar_fill(marts: DataFrame, key: str, lo: str, hi: str, metrics: list[str]) -> DataFrame:
    """Every key with every month of the range; months without rows have zeros."""
    keys = marts.select(key).distinct()
    grid = keys.withColumn("deal_ym", F.explode(F.transform(F.sequence(F.lit(int(lo[:4]) * 12 + int(lo[4:])), F.lit(int(hi[:4]) * 12 + int(hi[4:]))), month_text)))
    return grid.join(marts.select(key, "deal_ym", *metrics), [key, "deal_ym"], "left").select(key, "deal_ym", *(F.coalesce(m, F.lit(0)).alias(m) for m in metrics))


def uncollected(done: DataFrame, keys: DataFrame, lo: str, hi: str) -> DataFrame:
    """(sgg_cd, deal_ym) of the range without a finished load (Q27)."""
    grid = keys.select("sgg_cd").withColumn("deal_ym", F.explode(F.transform(F.sequence(F.lit(int(lo[:4]) * 12 + int(lo[4:])), F.lit(int(hi[:4]) * 12 + int(hi[4:]))), month_text)))
    return grid.join(done.select("sgg_cd", "deal_ym"), ["sgg_cd", "deal_ym"], "left_anti")


def rolling_median(rows: DataFrame, by: list[str], value: str, months: int = WINDOW_MONTHS) -> DataFrame:
    """by, no (the window's last month), n and median over windows of `months` months (Q31).

    Rows are first counted per month and value, so each different value enters the windows once, not each contract.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, month_no(F.col("deal_ym")).alias("m"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    wide = counts.withColumn("no", F.explode(F.sequence(F.col("m"), F.col("m") + months - 1))).groupBy(*by, "no", "v").agg(F.sum("c").alias("c"))
    group = W.partitionBy(*by, "no")
    run = wide.withColumn("end", F.sum("c").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(group))
    start, at = F.col("end") - F.col("c"), (F.col("n") - 1) * 0.5
    at_rank = lambda r: F.max(F.when((start <= r) & (r < F.col("end")), F.col("v")))
    out = run.groupBy(*by, "no").agg(F.max("n").alias("n"), at_rank(F.floor(at)).alias("lo"), at_rank(F.ceil(at)).alias("hi"))
    return out.select(*by, "no", "n", (F.col("lo") + (at - F.floor(at)) * (F.col("hi") - F.col("lo"))).alias("median"))


def done_partitions(states: DataFrame) -> DataFrame:
    """(sgg_cd, source, deal_ym) whose data a publish has taken in: the last load is older than the last publish, or an
    earlier load exists (Q35)."""
    ok = F.col("published_at").isNotNull() & F.col("last_changed_at").isNotNull() & ((F.col("last_changed_at") < F.col("published_at")) | F.col("rows_prev").isNotNull())
    return states.where(ok).select("sgg_cd", "source", "deal_ym")


def last_published(publishes: DataFrame) -> DataFrame:
    """(source, deal_ym, published_at) from publishes with an array of partitions (Q35)."""
    return publishes.select("published_at", F.explode("partitions").alias("p")).groupBy(F.col("p.source").alias("source"), F.col("p.deal_ym").alias("deal_ym")).agg(F.max("published_at").alias("published_at"))


def complete_windows(done: DataFrame, sources: int, months: int = WINDOW_MONTHS) -> DataFrame:
    """(sgg_cd, no): windows all of whose months are done in all sources (Q36)."""
    cells = done.distinct().withColumn("m", month_no(F.col("deal_ym")))
    return cells.withColumn("no", F.explode(F.sequence(F.col("m"), F.col("m") + months - 1))).groupBy("sgg_cd", "no").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") == sources * months).select("sgg_cd", "no")


def jeonse_ratio(trades: DataFrame, rents: DataFrame, complete: DataFrame, months: int = WINDOW_MONTHS, least: int = MIN_RATIO) -> DataFrame:
    """sgg_cd, no, samples, medians and ratio_pct of rolling windows; null unless both samples suffice and the window is
    complete (Q32-Q34)."""
    t = rolling_median(trades, ["sgg_cd"], "ppm2", months).withColumnsRenamed({"n": "nt", "median": "trade_median"})
    j = rolling_median(rents, ["sgg_cd"], "deposit_ppm2", months).withColumnsRenamed({"n": "nj", "median": "jeonse_median"})
    both = t.join(j, ["sgg_cd", "no"], "full_outer").join(complete.withColumn("complete", F.lit(True)), ["sgg_cd", "no"], "left")
    ok = (F.col("nt") >= least) & (F.col("nj") >= least) & F.col("complete")
    shown = lambda c: F.when(F.col("complete"), F.col(c)).alias(c)
    return both.select("sgg_cd", "no", F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("nj", F.lit(0)).alias("nj"), shown("trade_median"), shown("jeonse_median"), F.when(ok, F.round(F.try_divide(F.col("jeonse_median"), F.nullif(F.col("trade_median"), F.lit(0.0))) * 100, 1)).alias("ratio_pct"))


def complex_rent_bands(rents: DataFrame, trades: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Area bands of a complex: jeonse sample and median deposit, trade sample and median price, and their ratio if both
    have `least` rows (Q37). Deposit medians keep outliers."""
    b = lambda df: df.where(F.col("area_m2") > 0).withColumn("band", band(F.col("area_m2"), AREA_EDGES, False))
    j = exact_percentiles(b(rents.where("is_jeonse")).withColumn("x", F.col("deposit_manwon").cast("double")), [*by, "band"], "x", {"jeonse_median": 0.5}).withColumnRenamed("n", "nj")
    t = exact_percentiles(b(trades.where(~F.col("is_cancelled"))).withColumn("x", F.col("price_manwon").cast("double")), [*by, "band"], "x", {"trade_median": 0.5}).withColumnRenamed("n", "nt")
    ratio = F.when((F.col("nj") >= least) & (F.col("nt") >= least), F.try_divide(F.col("jeonse_median") * 100, F.nullif(F.col("trade_median"), F.lit(0.0))))
    return j.join(t, [*by, "band"], "full_outer").withColumn("ratio_pct", F.round(ratio, 1))


def files_for_version(versions: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """The file of each month as of a version: the last at or before it, since the first baseline (Q41).

    versions: version, published_at, publish_id, snapshot_baseline. files: publish_id, deal_ym, object_key.
    """
    order = F.struct("published_at", "version")
    start = versions.where("snapshot_baseline").agg(F.min(order).alias("start"))
    end = versions.where(F.col("version") == target).agg(F.max(order).alias("end"))
    known = versions.join(F.broadcast(start), order >= F.col("start")).join(F.broadcast(end), order <= F.col("end"))
    return files.join(known.select("publish_id", order.alias("o")), "publish_id").groupBy("deal_ym").agg(F.max_by("object_key", "o").alias("object_key"))


def kept_versions(versions: DataFrame, now: str, days: int = 30, monthly_days: int = 365, zone: str = "Asia/Seoul") -> DataFrame:
    """Versions that stay: all of the last `days`, the last of each month for monthly_days, and the latest (Q42)."""
    order = F.struct("published_at", "version")
    start = versions.where("snapshot_baseline").agg(F.min(order).alias("start"))
    known = versions.where("publish_id is not null").join(F.broadcast(start), order >= F.col("start")).drop("start")
    month = F.date_format(F.from_utc_timestamp("published_at", zone), "yyyyMM")
    ranked = known.withColumn("month", month).withColumn("last", F.row_number().over(W.partitionBy("month").orderBy(F.desc("published_at"), F.desc("version"))))
    latest = known.agg(F.max(order).alias("latest"))
    at = F.lit(now).cast("timestamp")
    young = lambda d: F.col("published_at") >= at - F.expr(f"interval {int(d)} days")
    return ranked.join(F.broadcast(latest), F.lit(True)).where(young(days) | ((F.col("last") == 1) & young(monthly_days)) | (order == F.col("latest"))).select(versions.columns)


def deletable_files(versions: DataFrame, files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files that no kept version uses. For every kept version the file of a month is the last at or before it (Q42)."""
    order = F.struct("published_at", "version")
    start = versions.where("snapshot_baseline").agg(F.min(order).alias("start"))
    known = versions.join(F.broadcast(start), order >= F.col("start")).select("publish_id", order.alias("o"))
    live = files.where("deleted_at is null") if "deleted_at" in files.columns else files
    # Versions are one row a publish: their running number of kept ones tells whether a span of them holds any.
    marked = known.join(kept.select("publish_id", F.lit(1).alias("kept")).distinct(), "publish_id", "left")
    upto = marked.withColumn("upto", F.sum(F.coalesce("kept", F.lit(0))).over(W.orderBy("o")))
    placed = live.join(upto.select("publish_id", "o", (F.col("upto") - F.coalesce("kept", F.lit(0))).alias("before")), "publish_id")
    all_ = marked.agg(F.sum(F.coalesce("kept", F.lit(0))).alias("all"))
    # A file serves the versions from its own up to the next file of its month.
    after = F.lead("before").over(W.partitionBy("deal_ym").orderBy("o"))
    used = placed.withColumn("after", after).crossJoin(all_).where(F.coalesce("after", "all") > F.col("before")).select("publish_id", "deal_ym").distinct()  # all_ is one row
    return live.join(used, ["publish_id", "deal_ym"], "left_anti")


def feature_collection(shapes: DataFrame, key: str = "sgg_cd", geometry: str = "geometry") -> DataFrame:
    """(key, feature): a GeoJSON feature for each shape; the collection is their list by code (Q46)."""
    props = F.struct(*(c for c in shapes.columns if c != geometry))
    return shapes.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.col(geometry).alias("geometry"))).alias("feature")).orderBy(key)


def collection(shapes: DataFrame, key: str = "sgg_cd", geometry: str = "geometry", meta: dict[str, str] | None = None) -> DataFrame:
    """One row: the GeoJSON collection of all shapes by code, and its bounds and meta values. A boundary list is some
    hundreds of shapes, so the document is one value."""
    features = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("feature"))))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(features, lambda f: f["feature"]), ","), F.lit("]}"))
    return feature_collection(shapes, key, geometry).agg(F.count(F.lit(1)).alias("n"), document.alias("document"), *(F.lit(v).alias(k) for k, v in (meta or {}).items()))


def published(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """The published projection: the named columns in order, nulls replaced where a default is given (V3)."""
    return df.select(*(F.col(c) if default is None else F.coalesce(c, F.lit(default)).alias(c) for c, default in columns.items()))


def latest_quote(marts: DataFrame, key: str, today: str, settle_days: int = 30) -> DataFrame:
    """Each key's latest settled month with its median and the change against a year before."""
    settled = F.date_add(F.last_day(F.to_date(F.concat("deal_ym", F.lit("01")), "yyyyMMdd")), settle_days) < F.lit(today).cast("date")
    rows = with_changes(marts.where(settled), key, {"median_ppm2": 0})
    last = F.max_by(F.struct("deal_ym", "median_ppm2", "median_ppm2_yoy"), "deal_ym")
    return rows.groupBy(key).agg(last.alias("q")).select(key, "q.*")


def trailing(marts: DataFrame, key: str, n: int = 12) -> DataFrame:
    """Each key's trades and priced sample over its last n rows."""
    return last_points(marts, key, n).groupBy(key).agg(F.sum("trades").alias("trades"), F.sum("priced").alias("priced"))


def scope_of(ident: Column, rent: bool = False) -> tuple[Column, Column]:
    """The district and month that an id names, as partition predicates for its history."""
    at = 2 if rent else 1
    return F.substring(ident, at, 5), F.substring(ident, at + 6, 6)
