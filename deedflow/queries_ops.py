"""Registered queries, second part: leases, keys, merges, feeds, quality and operations, region rules, display rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedflow.adapters import view
from deedflow.functions import keys, typing, values
from deedflow.operators import checks, diff, scd2
from deedflow.plans import marts, quality, regions, serving
from deedflow.queries import (
    A_BAND, CHECKS, KEYED, KEPT, MONTH, ROLLUP, R_SERVED, SERVED, STATE_SQL, TWINS, USAGE, VERSIONS, _checks, _month_sql, _partition_states, _r_served, _raw, _rent_sql, _twins, _usage, _versions,
    MONTHLY, WIDE, mart, pct_sql, query, rent_rollup_month, region_rent_month,
)
from deedflow.sources import tables

# ---- leases


def _raw_rent(spark, d):
    """Source strings of the leases."""
    t = view(spark, d, "rent")
    text = {
        "sggCd": F.col("sgg_cd"), "umdNm": F.concat(F.lit("Dong "), "sido_cd"), "aptNm": F.col("complex_key"), "jibun": F.lit("01"), "excluUseAr": F.col("area_m2").cast("string"), "dealYear": F.year("deal_date").cast("string"),
        "dealMonth": F.month("deal_date").cast("string"), "dealDay": F.dayofmonth("deal_date").cast("string"), "deposit": F.format_number("deposit_manwon", 0), "monthlyRent": F.format_number("monthly_rent_manwon", 0), "floor": F.lit(" "),
        "contractType": F.coalesce("contract_type", F.lit(" ")), "useRRRight": F.coalesce("use_rr_right", F.lit(" ")), "preDeposit": F.concat(F.lit("-"), F.format_number("deposit_manwon", 0)),
    }
    return t.select("rent_id", F.create_map(*(x for k, v in text.items() for x in (F.lit(k), v))).alias("row"))


@query("SELECT rent_id, sgg_cd, deal_date, deposit_manwon, monthly_rent_manwon, area_m2::DECIMAL(9, 4)::VARCHAR AS area_m2, contract_type, use_rr_right, -deposit_manwon AS pre_deposit_manwon, 0 AS n_errors FROM rent", "rent")
def typed_rents(spark, d):
    """P8"""
    t = typing.typed_rents(_raw_rent(spark, d))
    return t.select("rent_id", "sgg_cd", "deal_date", "deposit_manwon", "monthly_rent_manwon", F.col("area_m2").cast("string").alias("area_m2"), "contract_type", "use_rr_right", "pre_deposit_manwon", (F.size("errors") + F.size("missing")).alias("n_errors"))


@query("""--with k AS (SELECT *, concat(sgg_cd, '|dong', sido_cd, '|1|', complex_key) AS place FROM rent)
SELECT rent_id AS source_id, concat('c_', substr(sha256(place), 1, 20)) AS complex_key, sha256(concat(place, '|', area_m2::DECIMAL(9, 4), '|', deal_date, '|', deposit_manwon, '|', monthly_rent_manwon, '|')) AS rent_key,
substr(sha256(concat(coalesce(contract_type, ''), '||', coalesce(use_rr_right, ''), '|', -deposit_manwon, '||')), 1, 32) AS attr_hash FROM k""", "rent")
def keyed_rents(spark, d):
    """K8"""
    k = keys.keyed_rents(typing.typed_rents(_raw_rent(spark, d)).withColumnRenamed("rent_id", "source_id"))
    return k.select("source_id", "complex_key", "rent_key", "attr_hash")


@query("SELECT concat('r', trade_id) AS rent_id, version, valid_from, valid_to FROM version", "version")
def rent_version(spark, d):
    """G9"""
    return marts.version_rows(view(spark, d, "version").withColumn("rent_id", F.concat(F.lit("r"), "trade_id")), ["rent_id", "version", "valid_from", "valid_to"])


R_ROLL = "SELECT *, CASE WHEN region_id = '00' THEN 'nation' ELSE 'sido' END AS level FROM (" + _rent_sql("region_id", WIDE.format("r_served"), WIDE.format("jeonse"), MONTHLY.format(WIDE.format("r_served"))) + ")"


@query(f"{R_SERVED} SELECT region_id, deal_ym, 'wolse' AS metric, wolse AS expected, wolse - 1 AS found FROM ({R_ROLL}) WHERE deal_ym LIKE '%03'", "rent")
def rent_rollup_reconciles(spark, d):
    """G13, on a rollup with a lease too few in every March"""
    rollup = rent_rollup_month(spark, d).withColumn("wolse", F.col("wolse") - F.col("deal_ym").endswith("03").cast("int"))
    return checks.reconcile_rollup(region_rent_month(spark, d), rollup, ["contracts", "jeonse", "wolse", "jeonse_priced", "outliers"])


_JEONSE = "is_jeonse and area_m2 > 0 and not is_outlier"


@query(f"{R_SERVED}, b AS (SELECT *, {A_BAND} AS band FROM jeonse) SELECT * FROM {pct_sql('b', 'sgg_cd, band', 'deposit_ppm2', {'median': 0.5})}", "rent")
def rent_by_area(spark, d):
    """Q28"""
    return serving.by_area(_r_served(spark, d), ["sgg_cd"], "deposit_ppm2", _JEONSE)


@query(f"""{R_SERVED} SELECT c.*, median_deposit, median_rent FROM (SELECT sgg_cd, count(*) AS n, count(*) FILTER (is_jeonse) AS jeonse FROM r_served GROUP BY 1) c LEFT JOIN (SELECT sgg_cd, median_deposit FROM {pct_sql("(SELECT * FROM r_served WHERE is_jeonse)", "sgg_cd", "deposit_manwon::DOUBLE", {"median_deposit": 0.5})}) USING (sgg_cd)
LEFT JOIN (SELECT sgg_cd, median_rent FROM {pct_sql("(SELECT * FROM r_served WHERE NOT is_jeonse)", "sgg_cd", "monthly_rent_manwon::DOUBLE", {"median_rent": 0.5})}) USING (sgg_cd)""", "rent")
def rent_summary(spark, d):
    """Q29"""
    return serving.rent_summary(_r_served(spark, d), ["sgg_cd"])


# ---- typing and keys


@query("SELECT o_orderkey, make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) AS day, CAST(NULL AS DATE) AS none FROM orders")
def short_dates(spark, d):
    """P5"""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("text", F.date_format("o_orderdate", "yy.M.d"))
    return o.select("o_orderkey", typing.short_date(F.concat(F.lit(" "), "text")).alias("day"), typing.short_date(F.concat("text", F.lit(".1"))).alias("none"))


@query("SELECT DISTINCT user_id % 50 AS part, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS schema_ver FROM (SELECT user_id % 50 AS user_id FROM events)")
def schema_versions(spark, d):
    """By partition, of payloads whose rows hold different fields"""
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("part"), "event_id")
    extra = F.when(F.col("part") % 3 == 1, "aptSeq").when(F.col("part") % 3 == 2, "unheardOf").otherwise("floor")
    rows = e.withColumn("row", F.create_map(F.lit("sggCd"), F.lit("1"), extra, F.lit("x")))
    return typing.schema_version(rows, "row", ["part"], {1: typing.TRADE_V1, 2: typing.TRADE_V2})


@query(r"SELECT p_partkey, concat(regexp_replace(p_name, '\s+', ' ', 'g'), ' A①') AS shown FROM (SELECT p_partkey, trim(p_name) AS p_name FROM part)".replace("①", "1"))
def display_names(spark, d):
    """K3: blanks of any kind become one, compatibility characters their plain forms"""
    text = F.concat(F.lit("　 "), F.replace("p_name", F.lit(" "), F.lit(" \t　")), F.lit("  Ａ① "))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", keys.display_text(text).alias("shown"))


@query(KEYED.replace("lower(umd_nm)", "CASE WHEN sgg_cd LIKE '12%' AND umd_nm = 'BUILDING' THEN 'oldtown' ELSE lower(umd_nm) END") + " SELECT trade_id, complex_key, trade_key FROM h", "trade")
def aliased_keys(spark, d):
    """K5: in one province a neighbourhood goes by its old name in keys"""
    rows = typing.typed_trades(_raw(spark, d)).withColumnRenamed("trade_id", "source_id")
    aliases = view(spark, d, "trade").select("sgg_cd").distinct().where("sgg_cd like '12%'").select("sgg_cd", F.lit("building").alias("new_nm"), F.lit("Old Town").alias("old_nm"))
    return keys.keyed_trades(rows, aliases).select(F.col("source_id").alias("trade_id"), "complex_key", "trade_key")


# ---- merges


def _complex_stage(spark, d):
    t = view(spark, d, "trade")
    return t.select("complex_key", "complex_no", "sgg_cd", "umd_nm", F.lit("1").alias("jibun"), F.lit("a").alias("apt_nm"), "build_year", "deal_date", (F.col("complex_no") % 3).cast("string").alias("apt_seq"))


def _lease_dims(spark, d):
    """Dimension of half the complexes without build years, the leases' stage, and complexes that have trades."""
    stage = _complex_stage(spark, d)
    dim = stage.where("complex_no % 2 = 0").groupBy("complex_key").agg(*(F.min(c).alias(c) for c in ("sgg_cd", "umd_nm", "jibun", "apt_nm")), F.lit(None).cast("int").alias("build_year"), F.lit(None).cast("boolean").alias("land_leasehold"), F.lit("1996-01-01").cast("date").alias("first_seen"), F.lit(None).cast("string").alias("apt_seq"))
    traded = stage.where("complex_no % 4 = 0").select("complex_key").distinct()
    return dim, stage, traded


LEASE = "--with s AS (SELECT complex_key, min(sgg_cd) AS sgg_cd, min(deal_date) AS first_seen, max(build_year) AS build_year, min(complex_no) AS no FROM trade GROUP BY 1), r AS (SELECT complex_key, sgg_cd, CASE WHEN no % 2 = 0 THEN least(first_seen, DATE '1996-01-01') ELSE first_seen END AS first_seen, CASE WHEN no % 4 <> 0 THEN build_year END AS build_year, CASE WHEN no % 4 <> 0 THEN (no % 3)::VARCHAR END AS apt_seq, no FROM s)"


@query(LEASE + " SELECT complex_key, sgg_cd, first_seen, build_year, apt_seq FROM r", "trade")
def rent_complex_merge(spark, d):
    """M6: complexes that have trades keep their values, but are first seen earlier"""
    dim, stage, traded = _lease_dims(spark, d)
    return scd2.merge_complexes(dim, stage, traded).select("complex_key", "sgg_cd", "first_seen", "build_year", "apt_seq")


@query(LEASE + " SELECT count(*) FILTER (no % 2 = 1) AS inserted, count(*) FILTER (no % 2 = 0 AND (first_seen <> DATE '1996-01-01' OR build_year IS NOT NULL OR apt_seq IS NOT NULL)) AS fixed FROM r", "trade")
def complex_catch_up(spark, d):
    """M7"""
    dim, stage, traded = _lease_dims(spark, d)
    return scd2.catch_up(dim, scd2.merge_complexes(dim, stage, traded))


@query("SELECT event_id, user_id % 20 AS load, TIMESTAMP '2024-03-01' + to_days((event_id % 20)::INT) AS seen_at, (event_id % 20)::INT AS fetch_seq FROM events WHERE event_id % 20 < 7")
def stage_rows(spark, d):
    """M8: rows of the seven loads in force, of twenty, with this observation's time"""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 20).alias("ingest_id"), (F.col("user_id") % 20).alias("load"))
    loaded = spark.range(7).select(F.col("id").alias("ingest_id"), (F.lit("2024-03-01").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).cast("timestamp_ntz").alias("fetched_at"), F.col("id").cast("int").alias("fetch_count"))
    return scd2.stage_rows(e, loaded).select("event_id", "load", "seen_at", "fetch_seq")


@query("""--with s AS (SELECT DISTINCT complex_key, concat(complex_no % 700, CASE WHEN complex_no % 50 = 0 THEN concat('-', floor::INT) ELSE '' END) AS q, complex_no FROM trade WHERE floor IS NOT NULL)
SELECT (SELECT count(*) FROM (SELECT complex_key FROM s GROUP BY 1 HAVING count(DISTINCT q) > 1)) AS conflicts, (SELECT count(*) FROM (SELECT q FROM s GROUP BY 1 HAVING count(DISTINCT complex_key) > 1)) AS splits, (SELECT count(DISTINCT complex_key) FROM s WHERE complex_no % 9 = 0 AND q <> concat(complex_no % 700, '')) AS changed""", "trade")
def serial_conflicts(spark, d):
    """M11"""
    serial = F.concat((F.col("complex_no") % 700).cast("string"), F.when(F.col("complex_no") % 50 == 0, F.concat(F.lit("-"), F.col("floor").cast("string"))).otherwise(""))
    stage = view(spark, d, "trade").where("floor is not null").select("complex_key", "complex_no", serial.alias("apt_seq"))
    dim = stage.where("complex_no % 9 = 0").select("complex_key", (F.col("complex_no") % 700).cast("string").alias("apt_seq")).distinct()
    return scd2.serial_conflicts(stage, dim)


@query("SELECT n_nationkey AS region_cd, CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) ELSE n_name END AS nm, n_nationkey % 3 > 0 AS active FROM nation WHERE n_nationkey % 5 > 0 OR n_nationkey % 3 > 0")
def merged_regions(spark, d):
    """M12"""
    n = spark.read.parquet(f"{d}/nation.parquet")
    old = n.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("region_cd"), F.col("n_name").alias("nm"))
    new = n.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("region_cd"), F.lower("n_name").alias("nm"))
    return scd2.merge_regions(old, new)


@query("SELECT user_id, unnest(['a', 'b', 'c']) AS priority, unnest([greatest(max(event_id % 7), 3), max(event_id % 7), 3]) AS calls FROM events GROUP BY user_id")
def greatest_counts(spark, d):
    """M13"""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max(F.col("event_id") % 7).alias("m"))
    m = scd2.greatest_by_key(F.create_map(F.lit("a"), F.col("m"), F.lit("b"), F.col("m")), F.create_map(F.lit("a"), F.lit(3).cast("long"), F.lit("c"), F.lit(3).cast("long")))
    return e.select("user_id", F.explode(m).alias("priority", "calls"))


# ---- serving


SUMMED = f"""{SERVED}, m AS (SELECT *, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no FROM ({_month_sql("served", "priced", "sgg_cd")})),
c AS (SELECT a.sgg_cd, CASE WHEN a.priced >= 30 AND y.priced >= 30 THEN round((a.median_ppm2 - y.median_ppm2) * 100.0::DOUBLE / nullif(y.median_ppm2, 0), 2) END AS median_ppm2_yoy, round((a.trades - y.trades) * 100.0::DOUBLE / nullif(y.trades, 0), 2) AS trades_yoy FROM m a LEFT JOIN m y ON a.sgg_cd = y.sgg_cd AND y.no = a.no - 12 WHERE a.deal_ym = '{MONTH}')"""


@query(SUMMED + " SELECT sgg_cd, trades_yoy FROM c WHERE trades_yoy IS NOT NULL ORDER BY trades_yoy DESC, sgg_cd LIMIT 10", "trade")
def ranking_gainers(spark, d):
    """Q24"""
    return serving.ranking(serving.district_summary(mart(spark, d, "region_month"), MONTH), "trades_yoy", True)


@query(SUMMED + " SELECT sgg_cd, trades_yoy FROM c WHERE trades_yoy IS NOT NULL ORDER BY trades_yoy, sgg_cd LIMIT 10", "trade")
def ranking_losers(spark, d):
    """Q24"""
    return serving.ranking(serving.district_summary(mart(spark, d, "region_month"), MONTH), "trades_yoy", False)


def _index(spark, d):
    """A series with gaps: the medians of the rollup without every third March."""
    return mart(spark, d, "rollup_month").where("median_ppm2 is not null and not (deal_ym like '%03' and cast(substr(deal_ym, 1, 4) as int) % 3 = 0)").select("region_id", "deal_ym", F.col("median_ppm2").alias("value"))


INDEX = f"{SERVED}, i AS (SELECT region_id, deal_ym, median_ppm2 AS value, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no, last_day(strptime(concat(deal_ym, '01'), '%Y%m%d')::DATE) + 30 < DATE '2001-05-10' AS ok FROM ({ROLLUP}) WHERE median_ppm2 IS NOT NULL AND NOT (deal_ym LIKE '%03' AND substr(deal_ym, 1, 4)::INT % 3 = 0)), x AS (SELECT a.*, round((a.value - b.value) * 100.0::DOUBLE / nullif(b.value, 0), 2) AS mom, round((a.value - y.value) * 100.0::DOUBLE / nullif(y.value, 0), 2) AS yoy FROM i a LEFT JOIN i b ON a.region_id = b.region_id AND b.no = a.no - 1 LEFT JOIN i y ON a.region_id = y.region_id AND y.no = a.no - 12)"


@query(INDEX + """ SELECT l.region_id, l.deal_ym, l.mom, l.yoy, s.deal_ym AS settled_ym, s.mom AS settled_mom, s.yoy AS settled_yoy, p.points FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY no DESC) = 1) l JOIN (SELECT * FROM x WHERE ok QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY no DESC) = 1) s USING (region_id)
JOIN (SELECT region_id, string_agg(deal_ym, ',' ORDER BY deal_ym) AS points FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY no DESC) <= 24) GROUP BY 1) p USING (region_id)""", "trade")
def index_summary(spark, d):
    """Q21"""
    s = serving.index_summary(_index(spark, d), "2001-05-10")
    return s.select("region_id", "latest.deal_ym", "latest.mom", "latest.yoy", F.col("settled.deal_ym").alias("settled_ym"), F.col("settled.mom").alias("settled_mom"), F.col("settled.yoy").alias("settled_yoy"), F.array_join(F.transform("points", lambda p: p["deal_ym"]), ",").alias("points"))


@query(INDEX + " SELECT region_id, deal_ym, CASE WHEN no - was = 1 THEN round((value - before) * 100.0::DOUBLE / nullif(before, 0), 2) END AS change FROM (SELECT *, lag(no) OVER w AS was, lag(value) OVER w AS before FROM i WHERE ok WINDOW w AS (PARTITION BY region_id ORDER BY no)) QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY no DESC) = 1", "trade")
def ticker(spark, d):
    """Q26"""
    return serving.ticker(_index(spark, d), "2001-05-10").select("region_id", "deal_ym", "change")


LOADS = "SELECT concat(user_id % 25, '') AS sgg_cd, CASE WHEN user_id % 2 = 0 THEN 'trade' ELSE 'rent' END AS source, concat('2024', lpad(concat(user_id % 12 + 1, ''), 2, '0')) AS deal_ym, max(ts) AS last_changed, count(*) > 60 AS again FROM {} GROUP BY 1, 2, 3"


@query(f"WITH s AS ({LOADS.format('events')}), p AS (SELECT source, deal_ym, max(day) AS day FROM (SELECT 'trade' AS source, deal_ym, TIMESTAMP '2024-01-30 12:00:00' AS day FROM s WHERE deal_ym < '202407' UNION ALL SELECT source, deal_ym, TIMESTAMP '2024-01-30 20:00:00' FROM s WHERE deal_ym > '202403') GROUP BY ALL) SELECT s.sgg_cd, s.source, s.deal_ym FROM s JOIN p USING (source, deal_ym) WHERE last_changed < day OR again")
def done_partitions(spark, d):
    """Q35: by the last publish that names the partition's month"""
    s = spark.sql(LOADS.format("{e}"), e=spark.read.parquet(f"{d}/events.parquet")).withColumn("last_changed_at", F.col("last_changed").cast("timestamp")).withColumn("rows_prev", F.when(F.col("again"), 1))
    part = lambda source: F.struct(source.alias("source"), "deal_ym")
    one = lambda rows, source, at: rows.agg(F.collect_set(part(source)).alias("partitions")).select(F.lit(at).cast("timestamp").alias("published_at"), "partitions")
    publishes = one(s.where("deal_ym < '202407'"), F.lit("trade"), "2024-01-30 12:00:00").unionByName(one(s.where("deal_ym > '202403'"), F.col("source"), "2024-01-30 20:00:00"))
    return serving.done_partitions(s.join(serving.last_published(publishes), ["source", "deal_ym"], "left"))


@query(f"WITH v AS ({VERSIONS.format('part')}) SELECT version FROM v WHERE p_partkey > 120 AND p_partkey <= 180")
def feed_window(spark, d):
    """Q39"""
    return diff.feed_window(_versions(spark, d)[0], "v120", "v180", "2024-07-01", 120)[1].select("version")


@query("SELECT 'v' AS since, 'VERSION_NOT_FOUND' AS code, NULL AS oldest UNION ALL SELECT 'v5', 'CHANGES_EXPIRED', 'v62' UNION ALL SELECT 'v61', 'CHANGES_EXPIRED', 'v62' UNION ALL SELECT 'v100', 'INVALID_CURSOR', NULL")
def feed_errors(spark, d):
    """Q39: an unknown version, one before the first baseline, one that is no longer kept, and a bound before the start"""
    v, out = _versions(spark, d)[0], []
    for since, until in (("v", None), ("v5", None), ("v61", None), ("v100", "v99")):
        try:
            diff.feed_window(v, since, until, "2024-07-01", 120)
        except diff.FeedError as e:
            out.append((since, e.code, e.oldest))
    return spark.createDataFrame(out, "since string, code string, oldest string")


@query("SELECT n_nationkey AS sgg_cd, concat('{\"type\":\"Feature\",\"properties\":{\"sgg_cd\":', n_nationkey, ',\"nm\":\"', n_name, '\"},\"geometry\":{\"type\":\"Point\",\"at\":', n_regionkey, '}}') AS feature FROM nation")
def region_features(spark, d):
    """Q46"""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("sgg_cd"), F.col("n_name").alias("nm"), F.struct(F.lit("Point").alias("type"), F.col("n_regionkey").alias("at")).alias("geometry"))
    return serving.feature_collection(n)


@query("SELECT count(*) AS n, concat('{\"type\":\"FeatureCollection\",\"features\":[', string_agg(concat('{\"type\":\"Feature\",\"properties\":{\"sgg_cd\":', n_nationkey, '},\"geometry\":{\"at\":', n_regionkey, '}}'), ',' ORDER BY n_nationkey), ']}') AS document, '2024' AS as_of FROM nation")
def region_collection(spark, d):
    """Q46: the collection and its meta values"""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("sgg_cd"), F.struct(F.col("n_regionkey").alias("at")).alias("geometry"))
    return serving.collection(n, meta={"as_of": "2024"})


@query(f"--with t AS (SELECT * FROM trade WHERE deal_ym = '{MONTH}') SELECT count(*) AS n, sum(price_manwon)::BIGINT AS price FROM t", "trade")
def month_filtered(spark, d):
    """G12"""
    return view(spark, d, "trade").where(values.month_filter(MONTH)).agg(F.count(F.lit(1)).alias("n"), F.sum("price_manwon").alias("price"))


# ---- bronze


def _bronze(spark, d):
    """Loads of districts by month: one field unheard of, one row unreadable, one of another district, some loads short."""
    t = _raw(spark, d).join(view(spark, d, "trade").select("trade_id", "sgg_cd", "deal_ym", "complex_no", "floor"), "trade_id").where(f"deal_ym = '{MONTH}'")
    row = F.when(F.col("complex_no") % 50 == 1, F.map_concat("row", F.create_map(F.lit("unheardOf"), F.lit("1")))).when(F.col("complex_no") % 50 == 2, F.map_concat(F.map_filter("row", lambda k, _: k != "dealAmount"), F.create_map(F.lit("dealAmount"), F.lit("abc")))).otherwise(F.col("row"))
    own = typing.typed_trades(t.select(F.col("sgg_cd").alias("sgg"), "deal_ym", "complex_no", row.alias("row"), row.alias("raw")))
    return own.select(F.col("sgg").alias("sgg_cd"), "deal_ym", F.when(F.col("complex_no") % 50 == 3, "99999").otherwise(F.col("sgg_cd")).alias("own_sgg"), F.date_format("deal_date", "yyyyMM").alias("own_ym"), F.col("raw").alias("row"), "missing", "errors", "complex_no")


@query(f"""--with t AS (SELECT sgg_cd, complex_no % 50 AS k FROM trade WHERE deal_ym = '{MONTH}' AND sgg_cd NOT LIKE '14%'), a AS (SELECT sgg_cd, count(*) AS n, count(*) FILTER (k = 1) AS u, count(*) FILTER (k = 2) AS e, count(*) FILTER (k = 3) AS w FROM t GROUP BY 1),
p AS (SELECT sgg_cd, CASE WHEN sgg_cd LIKE '11%' THEN NULL WHEN sgg_cd LIKE '13%' THEN 2 * count(*) ELSE count(*) END AS before FROM trade WHERE deal_ym = '{MONTH}' GROUP BY 1), b AS (SELECT p.sgg_cd, before, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM p LEFT JOIN a USING (sgg_cd))
SELECT sgg_cd, unnest(['unknown_fields', 'missing_fields', 'unreadable', 'wrong_partition', 'row_drop', 'row_change_warning']) AS check_name, unnest([u, 0, e, w, coalesce(before >= 20 AND n < before * 0.7, false)::INT, coalesce(abs(round((n - before)::DOUBLE / before, 3)) > 0.3, false)::INT])::BIGINT AS failed, n::DOUBLE AS metric FROM b""", "trade")
def bronze_checks(spark, d):
    """V7: a province without rows now, one of half the rows, one never loaded before"""
    rows = _bronze(spark, d)
    before = F.when(F.col("sgg_cd").startswith("11"), F.lit(None)).when(F.col("sgg_cd").startswith("13"), 2 * F.col("c")).otherwise(F.col("c"))
    previous = rows.groupBy("sgg_cd").agg(F.count(F.lit(1)).alias("c")).select("sgg_cd", before.alias("n"))
    return checks.validate_bronze(rows.where("sgg_cd not like '14%'"), previous, typing.TRADE_V1, typing.TRADE_REQUIRED).withColumnRenamed("check", "check_name")


@query(f"--with t AS (SELECT complex_no FROM trade WHERE deal_ym = '{MONTH}') SELECT 'row_matches_version' AS check_name, count(*) FILTER (complex_no % 50 = 1 OR complex_no % 7 = 0) AS failed, count(*)::DOUBLE AS metric FROM t", "trade")
def rows_match_versions(spark, d):
    """V9"""
    rows = _bronze(spark, d).withColumn("schema_ver", F.when(F.col("complex_no") % 7 == 0, 9).otherwise(1))
    return checks.version_mismatch(rows, {1: typing.TRADE_V1, 2: typing.TRADE_V2}).withColumnRenamed("check", "check_name")


@query(f"SELECT 'quarantine_rate' AS check_name, (count(*) FILTER (status = 'QUARANTINED') >= 0.2 * count(*))::BIGINT AS failed, count(*) FILTER (status = 'QUARANTINED')::DOUBLE / count(*) AS metric FROM ({STATE_SQL})")
def quarantine_rate(spark, d):
    """V9"""
    return checks.quarantine_rate(_partition_states(spark, d)).withColumnRenamed("check", "check_name")


@query("SELECT DISTINCT concat(user_id, '') AS payload_sha256, 0 AS row_ord FROM events WHERE user_id % 4 <> 0")
def appended_rows(spark, d):
    """Payloads that come twice are taken once, held ones not again"""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("payload_sha256"), F.lit(0).alias("row_ord"))
    return tables.append_new(e, e.where(F.col("payload_sha256").cast("int") % 4 == 0))


# ---- regions


def _places(spark, d):
    """Region rows of provinces, districts and neighbourhoods from nations and regions."""
    n = spark.read.parquet(f"{d}/nation.parquet").withColumns({"p": (F.col("n_regionkey") + 11).cast("string"), "c": (F.col("n_nationkey") + 100).cast("string")})
    row = lambda cd, sido, sgg, umd, nm: F.struct(cd.alias("region_cd"), sido.alias("sido_cd"), sgg.alias("sgg_cd"), umd.alias("umd_cd"), F.lit("00").alias("ri_cd"), nm.alias("locatadd_nm"))
    lit, cat = F.lit, F.concat
    province = cat(lit("Prov"), "p")
    district = cat(province, lit(" City"), (F.col("n_nationkey") % 5).cast("string"), F.when(F.col("n_nationkey") >= 10, cat(lit(" Gu"), F.col("n_nationkey").cast("string"))).otherwise(""))
    rows = F.array(row(cat("p", lit("00000000")), F.col("p"), lit("000"), lit("000"), province), row(cat("p", "c", lit("00000")), F.col("p"), F.col("c"), lit("000"), district), row(cat("p", "c", lit("101"), lit("00")), F.col("p"), F.col("c"), lit("101"), cat(district, lit(" 가"), "c", lit("읍"))))
    return n.select(F.explode(rows).alias("r")).select("r.*").distinct()


PLACES = "n AS (SELECT n_nationkey AS k, concat(n_regionkey + 11, '') AS p, concat(n_nationkey + 100, '') AS c FROM nation), s AS (SELECT *, concat('City', k % 5, CASE WHEN k >= 10 THEN concat(' Gu', k) ELSE '' END) AS nm FROM n)"


@query(f"WITH {PLACES} SELECT concat(p, c) AS sgg_cd, p AS sido_cd, concat('Prov', p) AS sido_nm, nm AS sgg_nm, NOT EXISTS (SELECT 1 FROM s x WHERE x.p = s.p AND starts_with(x.nm, concat(s.nm, ' '))) AS is_leaf FROM s")
def derived_regions(spark, d):
    """V11"""
    return regions.derive_regions(_places(spark, d)).drop("full_nm")


@query(f"WITH {PLACES} SELECT concat(p, c) AS sgg_cd, concat('가', c, '읍') AS new_nm, concat('가', c, '면') AS old_nm FROM s WHERE k % 2 = 0")
def derived_aliases(spark, d):
    """A township that became a town, others that did not"""
    rows = _places(spark, d)
    seen = rows.where("umd_cd = '101'").select(F.substring("region_cd", 1, 5).alias("sgg_cd"), F.substring("region_cd", 3, 3).alias("c"))
    even = F.col("c").cast("int") % 2 == 0
    return regions.derive_aliases(regions.official_names(rows), seen.select("sgg_cd", F.concat(F.lit("가"), "c", F.when(even, "면").otherwise("동")).alias("umd_nm")))


@query("SELECT concat('Prov', n_regionkey + 11) AS short, concat(n_regionkey + 11, '') AS sido_cd FROM nation GROUP BY n_regionkey UNION ALL SELECT concat('P', n_regionkey + 11), concat(n_regionkey + 11, '') FROM nation GROUP BY n_regionkey UNION ALL SELECT * FROM (VALUES ('전국', '00'), ('Prov', NULL), ('zzz', NULL)) t(a, b)")
def short_names(spark, d):
    """A prefix, letters in order, the nation, an ambiguous and an unknown name"""
    sido = _places(spark, d).where("sgg_cd = '000'").select("sido_cd", F.col("locatadd_nm").alias("sido_nm")).distinct()
    short = sido.select(F.explode(F.array("sido_nm", F.concat(F.lit("P"), "sido_cd"))).alias("short")).unionByName(spark.createDataFrame([("전국",), ("Prov",), ("zzz",)], "short string"))
    return regions.match_short_names(short, sido)


@query(f"WITH {PLACES} SELECT concat(p, c) AS sgg_cd, CASE WHEN starts_with(lower(nm), 'city3') THEN 0 WHEN contains(lower(nm), ' city3') THEN 1 WHEN contains(lower(nm), 'city3') THEN 2 END AS rank FROM s WHERE contains(lower(nm), 'city3') ORDER BY rank, sgg_cd LIMIT 10")
def region_search(spark, d):
    """W9"""
    return quality.region_search(regions.derive_regions(_places(spark, d)), "City3").select("sgg_cd", "rank")


# ---- quality and operations


ST = f"SELECT *, 'trade' AS source, sgg_cd::INT % 4 AS k, TIMESTAMP '2024-01-01' + to_days((sgg_cd::INT % 40)) AS seen FROM ({STATE_SQL})"


def _states(spark, d):
    """Partition states with what a fetch leaves behind."""
    s = _partition_states(spark, d).withColumn("k", F.col("sgg_cd").cast("int") % 4)
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("sgg_cd").cast("int") % 40)
    null = lambda t: F.lit(None).cast(t)
    return s.withColumns({
        "attempts": F.col("k"), "rows_prev": null("long"), "rows_last": F.when(F.col("k") < 3, 5 * F.col("k").cast("long")), "payload_sha256": F.lit("h"), "last_ingest_id": F.lit("i1"), "merged_ingest_id": F.when(F.col("k") != 1, "i1"),
        "schema_ver": F.when(F.col("k") == 2, 2).otherwise(null("int")), "last_fetched_at": at, "last_changed_at": at, "next_due_at": at, "fetch_count": F.col("k"), "last_error": null("string"),
    })


@query(f"WITH s AS ({ST}) SELECT CASE WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'unrecorded' ELSE '2' END AS bucket, count(*) AS n FROM s WHERE k < 3 GROUP BY 1")
def version_counts(spark, d):
    """O1"""
    return quality.version_counts(_states(spark, d))


KINDS = "['loaded', 'unchanged', 'failed', 'rejected', 'released', 'interrupted', 'merged']"


@query(f"""WITH s AS (SELECT *, (sgg_cd::INT + deal_ym::INT) % 9 AS o FROM ({ST})), x AS (SELECT *, {KINDS}[o + 1] AS kind, TIMESTAMP '2024-02-01' AS now, (2024 * 12 + 2) - (substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT) AS age FROM s)
SELECT sgg_cd, deal_ym, CASE kind WHEN 'loaded' THEN 'LOADED' WHEN 'unchanged' THEN CASE WHEN k = 1 THEN 'LOADED' ELSE 'MERGED' END WHEN 'failed' THEN CASE WHEN k + 1 >= 3 THEN 'QUARANTINED' ELSE 'RETRY' END WHEN 'rejected' THEN 'QUARANTINED' WHEN 'released' THEN 'RETRY' WHEN 'interrupted' THEN 'RETRY' WHEN 'merged' THEN 'MERGED' ELSE status END AS status,
CASE WHEN kind IN ('loaded', 'unchanged') THEN 0 WHEN kind IN ('failed', 'rejected') THEN k + 1 ELSE k END AS attempts, CASE WHEN kind IN ('loaded', 'unchanged') THEN k + 1 ELSE k END AS fetch_count,
CASE WHEN kind IN ('failed', 'rejected', 'released', 'interrupted') THEN concat('e', o) END AS last_error, CASE WHEN kind = 'loaded' THEN 7 WHEN k < 3 THEN 5 * k END::BIGINT AS rows_last, CASE WHEN kind = 'loaded' THEN CASE WHEN k < 3 THEN 5 * k END END::BIGINT AS rows_prev,
strftime(CASE WHEN kind IN ('loaded', 'unchanged') THEN now + to_days(CASE WHEN age < 3 THEN 1 WHEN age < 12 THEN 30 ELSE 90 END) WHEN kind IN ('failed', 'rejected') THEN now + to_minutes(30 * (k + 1)) WHEN kind = 'interrupted' THEN now + INTERVAL 1 HOUR ELSE seen END, '%Y-%m-%d %H:%M') AS next_due FROM x""")
def state_transitions(spark, d):
    """O19"""
    s = _states(spark, d)
    o = (F.col("sgg_cd").cast("int") + F.col("deal_ym").cast("int")) % 9
    kind = F.try_element_at(F.array(*map(F.lit, "loaded unchanged failed rejected released interrupted merged".split())), o + 1)
    seen = s.select("source", "sgg_cd", "deal_ym", kind.alias("kind"), F.lit("2024-02-01").cast("timestamp").alias("at"), F.concat(F.lit("e"), o.cast("string")).alias("error"), F.lit(7).cast("long").alias("rows"), F.lit("h2").alias("sha"), F.lit("i2").alias("ingest_id"), F.lit(1).alias("schema_ver")).where("kind is not null")
    other = seen.withColumn("source", F.lit("rent")).withColumn("kind", F.lit("rejected"))  # the same cells of another source
    t = quality.transitions(s, seen.unionByName(other))
    return t.select("sgg_cd", "deal_ym", "status", "attempts", "fetch_count", "last_error", "rows_last", "rows_prev", F.date_format("next_due_at", "yyyy-MM-dd HH:mm").alias("next_due"))


@query(f"WITH s AS ({ST}) SELECT 'trade' AS source, date_diff('second', max(seen), TIMESTAMP '2024-03-01') AS freshness_s, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'QUARANTINED') AS quarantined, count(*) AS partitions FROM s")
def gauges(spark, d):
    """O20, O24"""
    return quality.gauges(_states(spark, d), "2024-03-01").drop("data_as_of")


@query(f"WITH s AS ({ST}) SELECT count(*) > 0 AS pending FROM s WHERE deal_ym BETWEEN '199703' AND '199711' AND seen <= TIMESTAMP '2024-01-20'")
def recheck_pending(spark, d):
    """O25"""
    return quality.recheck_pending(_states(spark, d).withColumn("next_due_at", F.when(F.col("next_due_at") <= "2024-01-20", F.lit("1998-01-01").cast("timestamp"))), "1998-02-01").agg((F.count(F.lit(1)) > 0).alias("pending"))


@query("SELECT count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS worst FROM events")
def overlap_meta(spark, d):
    """O21"""
    return quality.overlap_meta(spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("area_error")))


@query("SELECT count(*) FILTER (event_type = 'view') AS incremental, count(*) FILTER (event_type = 'click') AS recheck, count(*) FILTER (event_type = 'signup') AS backfill, count(*) AS used FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'")
def budget_day(spark, d):
    """O22"""
    names = F.create_map(*(F.lit(x) for kv in {"view": "incremental", "click": "recheck", "signup": "backfill"}.items() for x in kv))
    calls = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day"), F.coalesce(names[F.col("event_type")], F.lit("other")).alias("priority"), F.lit(1).alias("calls"))
    return quality.budget_day(calls, "2024-01-09")


@query("WITH m AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS merged, max(ts) FILTER (event_type = 'click') AS published FROM events GROUP BY 1) SELECT count(*) FILTER (published IS NULL OR merged > published) AS pending, count(*) FILTER (merged <= published) AS published FROM m WHERE merged IS NOT NULL")
def month_counts(spark, d):
    """O22"""
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    return quality.month_counts(spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(of("view").alias("merged_at"), of("click").alias("published_at")))


@query("SELECT concat('v', max(p_partkey)) AS version FROM part")
def last_version(spark, d):
    """O22"""
    return quality.last_version(_versions(spark, d)[0]).select("version")


@query(f"WITH v AS ({VERSIONS.format('part')}) SELECT concat('v', max(p_partkey)) AS version FROM v WHERE p_partkey % 5 = 2")
def version_with_month(spark, d):
    """O5"""
    v = _versions(spark, d)[0].withColumn("partitions", F.array(F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string")), F.lit("x")))
    return quality.last_version_with(v, "m2").select("version")


@query("SELECT concat('f', max(p_partkey)) AS object_key FROM part WHERE p_partkey % 7 = 4")
def last_month_file(spark, d):
    """O23"""
    v, files = _versions(spark, d)
    return quality.last_month_file(files, v, "m4")


def _latest_latency(spark, d):
    from deedflow.queries import _latency

    return _latency(spark, d)


def _latency_sql() -> str:
    from deedflow.queries import LATENCY

    return LATENCY + " SELECT lag_days, sum(n)::BIGINT AS n FROM latency WHERE metric = 'L2' AND reason = '' AND observed_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1"


@query(_latency_sql(), "version")
def latency_distribution(spark, d):
    """O6"""
    return quality.latency_distribution(_latest_latency(spark, d), "L2", "2024-01-05", "2024-01-25")


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('error', 'signup')").select(F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit('run {"password": "p'), "event_id", F.lit('"} '), "event_type").alias("text"), "event_type", "event_id")
    return {"run": e.where("event_type = 'error'"), "fetch": e.where("event_type = 'signup'")}


LOG = "SELECT CASE event_type WHEN 'error' THEN 'run' ELSE 'fetch' END AS source, ts, event_id, event_type FROM events WHERE event_type IN ('error', 'signup')"


@query(f"WITH l AS ({LOG}) SELECT source, concat('run {{\"password\": \"***\"}} ', event_type) AS text, ts <= TIMESTAMP '2024-01-30 12:00:00' AS cleared, (SELECT count(*) FROM l WHERE contains(event_type, 'err')) AS total, (SELECT count(*) > 40 FROM l WHERE contains(event_type, 'err')) AS truncated, strftime(ts, '%m-%d %H:%M') AS day FROM l WHERE contains(event_type, 'err') ORDER BY ts DESC, source LIMIT 40")
def error_log(spark, d):
    """O11, W11, O26"""
    return quality.error_log(quality.error_entries(_log(spark, d), "2024-01-30 12:00:00", text="ERR"), 40).select("source", "text", "cleared", "total", "truncated", F.date_format("at", "MM-dd HH:mm").alias("day"))


@query(f"WITH l AS ({LOG}) SELECT source, count(*) AS n, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS open FROM l GROUP BY 1")
def error_counts(spark, d):
    """O11"""
    return quality.error_counts(quality.error_entries(_log(spark, d), "2024-01-20"))


@query("SELECT p_partkey, concat('serviceKey=***&n=', p_partkey, ' \"pwd\": \"***\", Authorization: *** db://u:***@h x_token=***') AS text FROM part")
def redacted(spark, d):
    """O26"""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("serviceKey=a"), k, F.lit("&n="), k, F.lit(' "pwd": "b'), k, F.lit('", Authorization: Bearer c'), k, F.lit(" db://u:d"), k, F.lit("@h x_token=e"), k)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", quality.redact(text).alias("text"))


@query(f"WITH c AS ({CHECKS.format('events')}) SELECT event_id, EXISTS (SELECT 1 FROM c x WHERE x.asset = c.asset AND x.part IS NOT DISTINCT FROM c.part AND x.passed AND x.seen_at > c.seen_at) AS resolved FROM c WHERE NOT passed")
def resolved_runs(spark, d):
    """O12"""
    runs = _checks(spark, d).select(F.col("asset").alias("job"), "part", F.col("passed").alias("ok"), "at", "event_id")
    return quality.resolved_runs(runs).select("event_id", "resolved")


@query(f"WITH u AS ({USAGE.format('events')}), a AS (SELECT client_id, strftime(seen_at + INTERVAL 9 HOUR, '%Y-%m') AS period, count(*) AS calls, count(*) FILTER (route = 'view') AS exports FROM u GROUP BY ALL) SELECT client_id, period, calls, exports FROM a")
def usage_sources(spark, d):
    """Calls of the service and exports, by client and local month"""
    u = _usage(spark, d)
    a = quality.usage_by(u, "month").select("client_id", "period", "calls")
    return quality.usage_sources(a, quality.usage_by(u.where("route = 'view'"), "month").select("client_id", "period", F.col("calls").alias("exports")))


@query(f"WITH s AS ({STATE_SQL}), g AS (SELECT DISTINCT sgg_cd FROM s), m AS (SELECT DISTINCT deal_ym FROM s) SELECT sgg_cd, deal_ym FROM g, m EXCEPT SELECT sgg_cd, deal_ym FROM s WHERE status <> 'RETRY'")
def missing_cells(spark, d):
    """O18"""
    s = _partition_states(spark, d)
    return quality.missing_cells(s.select("sgg_cd").distinct(), s.select("deal_ym").distinct(), s.where("status <> 'RETRY'"))


# ---- display


@query(SUMMED + " SELECT sgg_cd, CASE WHEN trades_yoy < -10 THEN 0 WHEN trades_yoy < -5 THEN 1 WHEN trades_yoy < -1 THEN 2 WHEN trades_yoy < 1 THEN 3 WHEN trades_yoy < 5 THEN 4 WHEN trades_yoy < 10 THEN 5 WHEN trades_yoy IS NOT NULL THEN 6 END AS class FROM c", "trade")
def yoy_classes(spark, d):
    """W2"""
    return serving.district_summary(mart(spark, d, "region_month"), MONTH).select("sgg_cd", quality.yoy_class(F.col("trades_yoy")).alias("class"))


@query(f"{SERVED}, m AS ({ROLLUP}), j AS (SELECT a.deal_ym, a.trades AS a, b.trades AS b FROM m a JOIN m b USING (deal_ym) WHERE a.region_id = '11' AND b.region_id = '00' AND b.deal_ym >= '199503') SELECT deal_ym, a * 100.0::DOUBLE / (SELECT arg_min(a, deal_ym) FROM j) AS a, b * 100.0::DOUBLE / (SELECT arg_min(b, deal_ym) FROM j) AS b FROM j", "trade")
def rebased_series(spark, d):
    """W5"""
    m = mart(spark, d, "rollup_month")
    of = lambda r, lo: m.where((F.col("region_id") == r) & (F.col("deal_ym") >= lo)).select("deal_ym", F.col("trades").alias("value"))
    return quality.rebased(of("11", "000000"), of("00", "199503"))
