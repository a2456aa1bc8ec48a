"""Registered queries over the driver's tables, and the same in SQL for an independent engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedflow.adapters import oracle, view
from deedflow.functions import keys, typing
from deedflow.operators import checks, diff, scd2
from deedflow.operators.percentile import exact_percentiles, nearest_rank
from deedflow.plans import control, hedonic, marts, quality, served, serving
from deedflow.sources.tables import Table, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MONTH, LO, HI = "199806", "199701", "199912"


def query(sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return add


def pct_sql(rel: str, by: str, value: str, pcts: dict[str, float]) -> str:
    """Percentiles by row number, as a subquery: the list form that the operator's counted form must equal."""
    pick = ", ".join(f"max(CASE WHEN r = floor((n - 1) * {p}::DOUBLE) THEN v END) AS {k}_lo, max(CASE WHEN r = ceil((n - 1) * {p}::DOUBLE) THEN v END) AS {k}_hi" for k, p in pcts.items())
    out = ", ".join(f"{k}_lo + ((n - 1) * {p}::DOUBLE - floor((n - 1) * {p}::DOUBLE)) * ({k}_hi - {k}_lo) AS {k}" for k, p in pcts.items())
    return f"(SELECT {by}, n, {out} FROM (SELECT {by}, max(n) AS n, {pick} FROM (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {rel}) GROUP BY {by}))"


Q3 = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
P_TRADE = "NOT is_cancelled AND area_m2 > 0"
SERVED = f"""--with valued AS (SELECT *, CASE WHEN area_m2 > 0 THEN price_manwon::DOUBLE / area_m2 END AS ppm2 FROM trade),
bounds AS (SELECT * FROM {pct_sql(f"(SELECT * FROM valued WHERE {P_TRADE})", "deal_ym", "ppm2", {"lo": 0.001, "hi": 0.999})}),
served AS (SELECT v.*, coalesce({P_TRADE} AND (ppm2 < lo OR ppm2 > hi), false) AS is_outlier FROM valued v LEFT JOIN bounds b USING (deal_ym)),
priced AS (SELECT * FROM served WHERE {P_TRADE} AND NOT is_outlier)
"""
R_SERVED = f"""--with r_valued AS (SELECT *, monthly_rent_manwon = 0 AS is_jeonse, CASE WHEN area_m2 > 0 THEN deposit_manwon::DOUBLE / area_m2 END AS deposit_ppm2 FROM rent),
r_bounds AS (SELECT * FROM {pct_sql("(SELECT * FROM r_valued WHERE is_jeonse AND area_m2 > 0)", "deal_ym", "deposit_ppm2", {"lo": 0.001, "hi": 0.999})}),
r_served AS (SELECT v.*, coalesce(is_jeonse AND area_m2 > 0 AND (deposit_ppm2 < lo OR deposit_ppm2 > hi), false) AS is_outlier FROM r_valued v LEFT JOIN r_bounds b USING (deal_ym)),
jeonse AS (SELECT * FROM r_served WHERE is_jeonse AND area_m2 > 0 AND NOT is_outlier)
"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.trade_serving(view(spark, sf_dir, "trade"))


def _r_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.rent_serving(view(spark, sf_dir, "rent"))


#: The published marts of each application and folder.
_TABLES: dict[tuple[str, str], Table] = {}
WORDS = {"renewal": "renewal", "new": "new", "used": "used"}


def mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A mart of the folder's tables from the served layout, which the first query of an application publishes."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TABLES:
        table = Table(spark, f"{shared_dir(spark)}/marts-{uuid.uuid4().hex}")
        served.publish_marts(table, view(spark, sf_dir, "trade"), view(spark, sf_dir, "rent"), WORDS)
        _TABLES[key] = table
    return _TABLES[key].read_months(name)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart(spark, sf_dir, "trade")


def _r_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart(spark, sf_dir, "rent")


def _month_sql(rel: str, sample: str, region: str) -> str:
    return f"""SELECT {region}, deal_ym, reported, trades, cancelled, priced, outliers, CASE WHEN priced >= 5 THEN p25 END AS p25_ppm2, CASE WHEN priced >= 5 THEN p50 END AS median_ppm2,
CASE WHEN priced >= 5 THEN p75 END AS p75_ppm2, priced < 5 AS low_sample FROM (SELECT {region}, deal_ym, count(*) AS reported, count(*) FILTER (NOT is_cancelled) AS trades, count(*) FILTER (is_cancelled) AS cancelled,
count(*) FILTER ({P_TRADE} AND NOT is_outlier) AS priced, count(*) FILTER (is_outlier) AS outliers FROM {rel} GROUP BY ALL) c LEFT JOIN {pct_sql(sample, f"{region}, deal_ym", "ppm2", Q3)} p USING ({region}, deal_ym)"""


WIDE = "(SELECT *, sido_cd AS region_id FROM {0} UNION ALL SELECT *, '00' AS region_id FROM {0})"
MONTH_SQL = SERVED + _month_sql("served", "priced", "sgg_cd")
ROLLUP = f"SELECT *, CASE WHEN region_id = '00' THEN 'nation' ELSE 'sido' END AS level FROM ({_month_sql(WIDE.format('served'), WIDE.format('priced'), 'region_id')})"


@query(f"--with v AS (SELECT deal_ym, price_manwon::DOUBLE AS x FROM trade) SELECT * FROM {pct_sql('v', 'deal_ym', 'x', {'p10': 0.1, 'p50': 0.5, 'p999': 0.999})}", "trade")
def exact_percentile_months(spark, d):
    """G1"""
    return exact_percentiles(view(spark, d, "trade").select("deal_ym", F.col("price_manwon").cast("double").alias("x")), ["deal_ym"], "x", {"p10": 0.1, "p50": 0.5, "p999": 0.999}, wide=True)


@query(SERVED + "SELECT trade_id, sgg_cd, deal_ym, ppm2, is_outlier FROM served", "trade")
def trade_serving(spark, d):
    """G2"""
    return _fresh(spark, d).select("trade_id", "sgg_cd", "deal_ym", "ppm2", "is_outlier")


@query(MONTH_SQL, "trade")
def region_month(spark, d):
    """G3"""
    return marts.region_month(_served(spark, d))


@query(SERVED + ROLLUP, "trade")
def rollup_month(spark, d):
    """G4"""
    return marts.rollup_month(_served(spark, d))


@query(SERVED + f"""SELECT region_id, deal_ym, 'trades' AS metric, trades AS expected, trades + 1 AS found FROM ({ROLLUP}) WHERE deal_ym LIKE '%06' AND region_id <> '12'
UNION ALL SELECT region_id, deal_ym, unnest(['reported', 'trades', 'cancelled', 'priced', 'outliers']), unnest([reported, trades, cancelled, priced, outliers]), NULL FROM ({ROLLUP}) WHERE deal_ym = '199707'""", "trade")
def rollup_reconciles(spark, d):
    """G13, on a rollup with wrong counts in every June and without one month"""
    s = _served(spark, d)
    wrong = F.col("deal_ym").endswith("06") & (F.col("region_id") != "12")
    rollup = marts.rollup_month(s).where("deal_ym <> '199707'").withColumn("trades", F.col("trades") + wrong.cast("int"))
    return checks.reconcile_rollup(marts.region_month(s), rollup, ["reported", "trades", "cancelled", "priced", "outliers"])


@query("SELECT trade_id, version, valid_from, valid_to, is_cancelled FROM version", "version")
def trade_version(spark, d):
    """G5, G9"""
    return marts.version_rows(view(spark, d, "version"), ["trade_id", "version", "valid_from", "valid_to", "is_cancelled"])


@query(R_SERVED + "SELECT rent_id, sgg_cd, deal_ym, is_jeonse, deposit_ppm2, is_outlier FROM r_served", "rent")
def rent_serving(spark, d):
    """G6"""
    return _r_fresh(spark, d).select("rent_id", "sgg_cd", "deal_ym", "is_jeonse", "deposit_ppm2", "is_outlier")


def _rent_sql(region: str, rel: str, sample: str, monthly: str) -> str:
    by = f"{region}, deal_ym"
    return f"""SELECT c.*, CASE WHEN jeonse_priced >= 5 THEN p25 END AS jeonse_p25_ppm2, CASE WHEN jeonse_priced >= 5 THEN p50 END AS jeonse_median_ppm2, CASE WHEN jeonse_priced >= 5 THEN p75 END AS jeonse_p75_ppm2,
CASE WHEN wolse >= 5 THEN r50 END AS wolse_median_rent, CASE WHEN wolse >= 5 THEN d50 END AS wolse_median_deposit, jeonse_priced < 5 AS low_sample
FROM (SELECT {by}, count(*) AS contracts, count(*) FILTER (is_jeonse) AS jeonse, count(*) FILTER (NOT is_jeonse) AS wolse, count(*) FILTER (contract_type = 'renewal') AS renewals, count(*) FILTER (contract_type = 'new') AS new_contracts,
count(*) FILTER (use_rr_right = 'used') AS rr_used, count(*) FILTER (is_jeonse AND area_m2 > 0 AND NOT is_outlier) AS jeonse_priced, count(*) FILTER (is_outlier) AS outliers FROM {rel} GROUP BY ALL) c
LEFT JOIN (SELECT {by}, p25, p50, p75 FROM {pct_sql(sample, by, "deposit_ppm2", Q3)}) USING ({by}) LEFT JOIN (SELECT {by}, r50 FROM {pct_sql(monthly, by, "monthly_rent_manwon::DOUBLE", {"r50": 0.5})}) USING ({by})
LEFT JOIN (SELECT {by}, d50 FROM {pct_sql(monthly, by, "deposit_manwon::DOUBLE", {"d50": 0.5})}) USING ({by})"""


MONTHLY = "(SELECT * FROM {} WHERE NOT is_jeonse)"


@query(R_SERVED + _rent_sql("sgg_cd", "r_served", "jeonse", MONTHLY.format("r_served")), "rent")
def region_rent_month(spark, d):
    """G7"""
    return marts.region_rent_month(_r_served(spark, d), "renewal", "new", "used")


@query(R_SERVED + "SELECT *, CASE WHEN region_id = '00' THEN 'nation' ELSE 'sido' END AS level FROM (" + _rent_sql("region_id", WIDE.format("r_served"), WIDE.format("jeonse"), MONTHLY.format(WIDE.format("r_served"))) + ")", "rent")
def rent_rollup_month(spark, d):
    """G8"""
    return marts.rent_rollup_month(_r_served(spark, d), "renewal", "new", "used")


DIM = "SELECT concat('c_', p_partkey) AS complex_key, p_name AS apt_nm, p_brand AS umd_nm, concat(p_partkey % 5 + 11, lpad(concat(p_partkey % 30, ''), 3, '0')) AS sgg_cd"


def _dim(spark, d):
    return spark.sql(DIM + " FROM {part}", part=spark.read.parquet(f"{d}/part.parquet"))


@query(f"--with dim AS ({DIM} FROM part), n AS (SELECT complex_key, count(*) AS trades FROM trade WHERE NOT is_cancelled GROUP BY 1) SELECT d.*, coalesce(trades, 0) AS trades FROM dim d LEFT JOIN n USING (complex_key) WHERE sgg_cd IN (SELECT sgg_cd FROM trade)", "trade")
def complex_summary(spark, d):
    """G10"""
    t = view(spark, d, "trade")
    return marts.complex_summary(_dim(spark, d), t, t.select("sgg_cd"))


VER = "SELECT trade_id, sgg_cd, concat(year(seen_on) * 100 + month(seen_on), '') AS deal_ym, CAST(valid_from - INTERVAL 2 DAY AS DATE) AS deal_date, version, valid_from, is_cancelled, CASE WHEN amount % 3 <> 0 THEN CAST(valid_from - INTERVAL 5 DAY AS DATE) END AS cancel_date FROM {}"


def _latency(spark, d):
    v = view(spark, d, "version").createOrReplaceTempView("deedflow_version") or spark.sql(VER.format("deedflow_version"))
    v = v.withColumn("valid_from", F.col("valid_from").cast("timestamp"))
    regions = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.col("n_regionkey") + 11, F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("sgg_cd"))
    return marts.source_latency(v, v.groupBy("sgg_cd", "deal_ym").agg((F.min("valid_from") + F.expr("interval 1 day")).alias("first_fetch")), regions)


LATENCY = f"""--with v AS ({VER.format("version")}), f AS (SELECT sgg_cd, deal_ym, min(valid_from) + INTERVAL 1 DAY AS first_fetch FROM v GROUP BY ALL),
w AS (SELECT *, lag(valid_from) OVER (PARTITION BY trade_id ORDER BY version) AS prev_from FROM v WHERE sgg_cd IN (SELECT concat(n_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0')) FROM nation)),
e AS (SELECT 'L1' AS metric, deal_date AS base_date, * FROM w WHERE version = 1 UNION ALL SELECT 'L2', cancel_date, * FROM w WHERE is_cancelled QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY version) = 1),
o AS (SELECT metric, base_date, CAST(valid_from + INTERVAL 9 HOUR AS DATE) AS observed_date, substr(e.sgg_cd, 1, 2) AS sido_cd, e.deal_ym, valid_from, prev_from, first_fetch FROM e JOIN f ON e.sgg_cd = f.sgg_cd AND e.deal_ym = f.deal_ym),
c AS (SELECT *, CASE WHEN valid_from < prev_from THEN 'time_inverted' WHEN valid_from <= first_fetch THEN 'initial_load' WHEN base_date IS NULL THEN 'no_base_date'
  WHEN year(observed_date) * 12 + month(observed_date) - substr(deal_ym, 1, 4)::INT * 12 - substr(deal_ym, 5, 2)::INT >= 3 THEN 'low_resolution' WHEN base_date > observed_date THEN 'negative_lag' ELSE '' END AS reason FROM o),
latency AS (SELECT metric, observed_date, sido_cd, reason, CASE WHEN reason = '' THEN date_diff('day', base_date, observed_date) END AS lag_days, count(*) AS n FROM c GROUP BY ALL)
"""


@query(LATENCY + "SELECT * FROM latency", "version")
def source_latency(spark, d):
    """G11"""
    return _latency(spark, d)


@query(LATENCY + """, h AS (SELECT metric, lag_days, sum(n) AS w FROM latency WHERE reason = '' GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY metric ORDER BY lag_days) AS run, sum(w) OVER (PARTITION BY metric) AS total FROM h)
SELECT metric, max(total)::BIGINT AS total, min(lag_days) FILTER (run >= total * 0.5) AS p50, min(lag_days) FILTER (run >= total * 0.9) AS p90, min(lag_days) FILTER (run >= total * 0.99) AS p99 FROM r GROUP BY metric""", "version")
def latency_percentiles(spark, d):
    """O6, O7"""
    return quality.latency_percentiles(_latency(spark, d), ["metric"])


@query(LATENCY + """SELECT metric, CASE WHEN lag_days <= 0 THEN '0' WHEN lag_days <= 3 THEN '1-3' WHEN lag_days <= 7 THEN '4-7' WHEN lag_days <= 14 THEN '8-14' WHEN lag_days <= 30 THEN '15-30' ELSE '31+' END AS bin, sum(n)::BIGINT AS n FROM latency WHERE reason = '' GROUP BY ALL""", "version")
def latency_bins(spark, d):
    """W6"""
    return quality.latency_bins(_latency(spark, d))


@query(f"""{SERVED}, m AS ({_month_sql("served", "priced", "sgg_cd")}), x AS (SELECT * FROM m UNION ALL SELECT * REPLACE (trades + 1 AS trades) FROM m WHERE deal_ym LIKE '%05'), n AS (SELECT count(*)::DOUBLE AS n FROM x)
SELECT 'unique:sgg_cd+deal_ym' AS check_name, (SELECT count(*) FROM m WHERE deal_ym LIKE '%05') AS failed, (SELECT count(*) FROM m)::DOUBLE AS metric
UNION ALL SELECT 'holds:trades + cancelled = reported', (SELECT count(*) FROM m WHERE deal_ym LIKE '%05'), n FROM n UNION ALL SELECT 'holds:p25_ppm2 <= median_ppm2 and median_ppm2 < p75_ppm2', (SELECT count(*) FROM x WHERE NOT (p25_ppm2 <= median_ppm2 AND median_ppm2 < p75_ppm2)), n FROM n
UNION ALL SELECT 'not_null:median_ppm2', (SELECT count(*) FROM x WHERE median_ppm2 IS NULL), n FROM n UNION ALL SELECT 'between:priced', (SELECT count(*) FROM x WHERE priced NOT BETWEEN 5 AND 40), n FROM n
UNION ALL SELECT 'accepted:low_sample', (SELECT count(*) FROM x WHERE low_sample), n FROM n UNION ALL SELECT 'related:sgg_cd', (SELECT count(*) FROM x WHERE sgg_cd LIKE '12%'), (SELECT count(*) FROM x WHERE sgg_cd LIKE '12%')""", "trade")
def data_checks(spark, d):
    """G14, on a mart with every May twice and wrong, and a region list without a province"""
    m = marts.region_month(_served(spark, d))
    x = m.unionByName(m.where(F.col("deal_ym").endswith("05")).withColumn("trades", F.col("trades") + 1))
    known = m.where(~F.col("sgg_cd").startswith("12"))
    rows = [checks.unique(x, ["sgg_cd", "deal_ym"]), checks.holds(x, "trades + cancelled = reported"), checks.holds(x, "p25_ppm2 <= median_ppm2 and median_ppm2 < p75_ppm2"), checks.not_null(x, "median_ppm2")]
    rows += [checks.between(x, "priced", 5, 40), checks.accepted(x, "low_sample", [False]), checks.related(x, "sgg_cd", known, "sgg_cd")]
    return checks.report(*rows).withColumnRenamed("check", "check_name")


@query("SELECT min(deal_ym) AS lo, max(deal_ym) AS hi FROM trade", "trade")
def month_bounds(spark, d):
    """Q1"""
    return serving.month_bounds(mart(spark, d, "region_month"))


@query(f"{SERVED}, m AS ({_month_sql('served', 'priced', 'sgg_cd')}) SELECT * FROM m WHERE deal_ym IN ('{MONTH}', '199805', '199706')", "trade")
def compared_months(spark, d):
    """Q2"""
    return serving.compared_months(mart(spark, d, "region_month"), MONTH)


@query(f"{SERVED}, m AS ({ROLLUP}) SELECT * FROM m WHERE deal_ym BETWEEN '{LO}' AND '{MONTH}' OR deal_ym = '199601'", "trade")
def range_or_month(spark, d):
    """Q3"""
    return serving.range_or_month(mart(spark, d, "rollup_month"), LO, MONTH, "199601")


@query(f"{SERVED}, m AS ({ROLLUP}) SELECT region_id, deal_ym, trades FROM m QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY deal_ym DESC) <= 3", "trade")
def last_points(spark, d):
    """Q4"""
    return serving.last_points(mart(spark, d, "rollup_month"), "region_id", 3).select("region_id", "deal_ym", "trades")


@query("SELECT DISTINCT sgg_cd, sido_cd FROM trade ORDER BY sgg_cd", "trade")
def region_list(spark, d):
    """Q5"""
    return serving.region_list(_served(spark, d), ["sgg_cd", "sido_cd"])


@query(f"{SERVED}, m AS ({_month_sql('served', 'priced', 'sgg_cd')}) SELECT deal_ym, trades, median_ppm2 FROM m WHERE sgg_cd = '12001' AND deal_ym BETWEEN '{LO}' AND '{HI}'", "trade")
def month_series(spark, d):
    """Q6: the district reaches the scan's side of the plan, the bounds stay nation-wide"""
    return serving.month_series(mart(spark, d, "region_month"), "12001", LO, HI).select("deal_ym", "trades", "median_ppm2")


Q5S = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query(f"{SERVED} SELECT c.*, p05, p25, p50, p75, p95 FROM (SELECT sgg_cd, count(*) AS n, count(*) FILTER (is_cancelled) AS cancelled, count(*) FILTER ({P_TRADE} AND NOT is_outlier) AS priced FROM served GROUP BY 1) c LEFT JOIN {pct_sql('priced', 'sgg_cd', 'ppm2', Q5S)} p USING (sgg_cd)", "trade")
def price_stats(spark, d):
    """Q7"""
    return serving.price_stats(_served(spark, d), ["sgg_cd"])


def _hist_sql(rel: str, value: str) -> str:
    return f"""w AS (SELECT sgg_cd, (p95 - p05) / 16 AS raw FROM {pct_sql(rel, "sgg_cd", value, {"p05": 0.05, "p95": 0.95})}),
u AS (SELECT sgg_cd, raw, pow(10.0::DOUBLE, floor(log10(CASE WHEN raw > 0 THEN raw END))) AS unit FROM w),
k AS (SELECT sgg_cd, CASE WHEN raw > 0 THEN (CASE WHEN raw <= unit THEN 1.0::DOUBLE WHEN raw <= 2 * unit THEN 2.0 WHEN raw <= 2.5::DOUBLE * unit THEN 2.5 WHEN raw <= 5 * unit THEN 5.0 ELSE 10.0 END) * unit ELSE 1.0 END AS width FROM u)
SELECT sgg_cd, floor({value} / width) * width AS bin, count(*) AS n FROM {rel} JOIN k USING (sgg_cd) GROUP BY ALL"""


@query(f"{SERVED}, {_hist_sql('priced', 'ppm2')}", "trade")
def histogram(spark, d):
    """Q8, Q9"""
    return serving.histogram(_served(spark, d), ["sgg_cd"])


A_BAND = "CASE WHEN area_m2 < 40 THEN 0 WHEN area_m2 < 60 THEN 1 WHEN area_m2 < 85 THEN 2 WHEN area_m2 < 135 THEN 3 ELSE 4 END"
F_BAND = "CASE WHEN floor <= 3 THEN 0 WHEN floor <= 10 THEN 1 WHEN floor <= 20 THEN 2 ELSE 3 END"


@query(f"{SERVED}, b AS (SELECT *, {A_BAND} AS band FROM priced) SELECT * FROM {pct_sql('b', 'sgg_cd, band', 'ppm2', {'median': 0.5})}", "trade")
def by_area(spark, d):
    """Q10"""
    return serving.by_area(_served(spark, d), ["sgg_cd"])


@query(f"--with b AS (SELECT *, {F_BAND} AS band FROM trade WHERE NOT is_cancelled AND floor IS NOT NULL) SELECT * FROM {pct_sql('b', 'sgg_cd, band', 'price_manwon::DOUBLE', {'median': 0.5})}", "trade")
def by_floor(spark, d):
    """Q11"""
    return serving.by_floor(_served(spark, d), ["sgg_cd"])


@query(f"{SERVED} SELECT trade_id, deal_date, area_m2, ppm2 FROM priced WHERE sgg_cd = '12001' ORDER BY deal_date, trade_id LIMIT 200", "trade")
def scatter_points(spark, d):
    """Q12"""
    return serving.points(_served(spark, d), F.col("sgg_cd") == "12001", 200)


@query(f"""{SERVED}, t AS (SELECT * FROM served WHERE sido_cd = '12' AND NOT is_cancelled), a AS (SELECT complex_key, count(*) AS n, max(deal_date) AS last_date, arg_max(price_manwon, (deal_date, trade_id)) AS last_price FROM t GROUP BY 1)
SELECT a.*, median FROM a LEFT JOIN (SELECT complex_key, median FROM {pct_sql("(SELECT * FROM priced WHERE sido_cd = '12')", "complex_key", "ppm2", {"median": 0.5})}) USING (complex_key) ORDER BY n DESC, median DESC NULLS LAST, complex_key LIMIT 20""", "trade")
def top_complexes(spark, d):
    """Q13"""
    return serving.top_complexes(_served(spark, d), F.col("sido_cd") == "12", 20)


@query("SELECT trade_id, deal_date, price_manwon FROM trade WHERE sgg_cd = '12001' AND (deal_date, trade_id) < (DATE '1999-03-01', '12001') ORDER BY deal_date DESC, trade_id DESC LIMIT 51", "trade")
def trade_page(spark, d):
    """Q14"""
    return serving.page(_served(spark, d), F.col("sgg_cd") == "12001", ("1999-03-01", "12001"), 50).select("trade_id", "deal_date", "price_manwon")


@query(f"""{SERVED} SELECT c.*, median_price, median_ppm2 FROM (SELECT sgg_cd, count(*) AS n, count(*) FILTER (is_cancelled) AS cancelled FROM served GROUP BY 1) c
LEFT JOIN (SELECT sgg_cd, median_price FROM {pct_sql("(SELECT * FROM served WHERE NOT is_cancelled)", "sgg_cd", "price_manwon::DOUBLE", {"median_price": 0.5})}) USING (sgg_cd) LEFT JOIN (SELECT sgg_cd, median_ppm2 FROM {pct_sql("priced", "sgg_cd", "ppm2", {"median_ppm2": 0.5})}) USING (sgg_cd)""", "trade")
def trade_summary(spark, d):
    """Q15"""
    return serving.trade_summary(_served(spark, d), ["sgg_cd"])


@query("SELECT trade_id, version, state FROM version WHERE trade_id = '7' ORDER BY version", "version")
def version_history(spark, d):
    """Q16: from the month partition that the first version names"""
    v = view(spark, d, "version").withColumn("deal_ym", F.lit("202401"))
    return serving.versions_of(v, "7", "202401").select("trade_id", "version", "state")


@query("SELECT concat('r', trade_id) AS rent_id, version, state FROM version WHERE trade_id = '11' ORDER BY version", "version")
def rent_version_history(spark, d):
    """Q30"""
    v = view(spark, d, "version").select(F.concat(F.lit("r"), "trade_id").alias("rent_id"), "version", "state", F.lit("202401").alias("deal_ym"))
    return serving.versions_of(v, "r11", "202401", "rent_id").select("rent_id", "version", "state")


@query("""--with w AS (SELECT *, lag(state) OVER x AS s, lag(amount) OVER x AS a FROM version WINDOW x AS (PARTITION BY trade_id ORDER BY version))
SELECT trade_id, version, CASE WHEN version = 1 THEN '' WHEN state <> s AND amount <> a THEN 'state,amount' WHEN state <> s THEN 'state' WHEN amount <> a THEN 'amount' ELSE 'untracked' END AS changed FROM w""", "version")
def history_diff(spark, d):
    """Q17"""
    return diff.version_diff(view(spark, d, "version"), "trade_id", ["state", "amount"]).withColumn("changed", F.array_join("changed", ","))


@query("SELECT trade_id, deal_date, price_manwon FROM trade WHERE complex_key = 'c_77' ORDER BY deal_date DESC, trade_id DESC LIMIT 11", "trade")
def complex_recent(spark, d):
    """Q18"""
    return serving.page(_served(spark, d), F.col("complex_key") == "c_77", None, 10).select("trade_id", "deal_date", "price_manwon")


@query(f"--with dim AS ({DIM} FROM part), n AS (SELECT complex_key, count(*) AS trades FROM trade WHERE NOT is_cancelled GROUP BY 1) SELECT complex_key, apt_nm, coalesce(trades, 0) AS trades FROM dim LEFT JOIN n USING (complex_key) WHERE contains(lower(apt_nm), 'ring') OR contains(lower(umd_nm), 'ring') ORDER BY trades DESC, complex_key LIMIT 15", "trade")
def complex_search(spark, d):
    """Q19"""
    t = view(spark, d, "trade")
    return serving.search(marts.complex_summary(_dim(spark, d), t, _dim(spark, d)), "RING").select("complex_key", "apt_nm", "trades")


@query(f"{SERVED}, m AS ({ROLLUP}) SELECT region_id, string_agg(concat(deal_ym, ':', trades), ',' ORDER BY deal_ym) AS series FROM m GROUP BY 1", "trade")
def index_series(spark, d):
    """Q20"""
    s = serving.series_arrays(mart(spark, d, "rollup_month"), "region_id", "trades")
    return s.select("region_id", F.array_join(F.zip_with("periods", "values", lambda p, v: F.concat(p, F.lit(":"), v)), ",").alias("series"))


@query(f"""{SERVED}, m AS (SELECT *, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no FROM ({_month_sql("served", "priced", "sgg_cd")}))
SELECT a.sgg_cd, a.trades, a.cancelled::DOUBLE / a.reported AS cancel_rate, CASE WHEN a.priced >= 30 AND y.priced >= 30 THEN round((a.median_ppm2 - y.median_ppm2) * 100.0::DOUBLE / nullif(y.median_ppm2, 0), 2) END AS median_ppm2_yoy,
round((a.trades - y.trades) * 100.0::DOUBLE / nullif(y.trades, 0), 2) AS trades_yoy, round((a.trades - b.trades) * 100.0::DOUBLE / nullif(b.trades, 0), 2) AS trades_mom
FROM m a LEFT JOIN m b ON a.sgg_cd = b.sgg_cd AND b.no = a.no - 1 LEFT JOIN m y ON a.sgg_cd = y.sgg_cd AND y.no = a.no - 12 WHERE a.deal_ym = '{MONTH}'""", "trade")
def district_summary(spark, d):
    """Q21, Q22, Q45"""
    return serving.district_summary(mart(spark, d, "region_month"), MONTH).select("sgg_cd", "trades", "cancel_rate", "median_ppm2_yoy", "trades_yoy", "trades_mom")


@query(f"{SERVED}, m AS ({ROLLUP}) SELECT region_id, string_agg(deal_ym, ',' ORDER BY deal_ym) AS months, string_agg(trades::VARCHAR, ',' ORDER BY deal_ym) AS trades FROM m WHERE deal_ym BETWEEN '199707' AND '{MONTH}' GROUP BY 1", "trade")
def region_spark(spark, d):
    """Q23, Q26"""
    s = serving.region_spark(mart(spark, d, "rollup_month"), MONTH)
    return s.select("region_id", F.array_join("months", ",").alias("months"), F.array_join(F.transform("trades", lambda x: x.cast("string")), ",").alias("trades"))


@query(f"{SERVED}, m AS ({_month_sql('served', 'priced', 'sgg_cd')}) SELECT sgg_cd, trades FROM m WHERE deal_ym = '{MONTH}' ORDER BY trades DESC, sgg_cd LIMIT 10", "trade")
def ranking_volume(spark, d):
    """Q24"""
    return serving.ranking(mart(spark, d, "region_month").where(F.col("deal_ym") == MONTH), "trades", True)


@query("SELECT max(deal_ym) AS month FROM trade WHERE last_day(deal_date) + 30 < DATE '2001-10-20'", "trade")
def default_month(spark, d):
    """Q25"""
    return serving.default_month(mart(spark, d, "region_month"), "2001-10-20", within=12)


@query("--with g AS (SELECT DISTINCT sgg_cd FROM trade), k AS (SELECT strftime(m, '%Y%m') AS deal_ym FROM unnest(generate_series(DATE '1994-11-01', DATE '1995-03-01', INTERVAL 1 MONTH)) t(m)) SELECT sgg_cd, deal_ym FROM g, k WHERE (sgg_cd, deal_ym) NOT IN (SELECT sgg_cd, deal_ym FROM trade)", "trade")
def uncollected_months(spark, d):
    """Q27, O18"""
    t = view(spark, d, "trade")
    return serving.uncollected(t.select("sgg_cd", "deal_ym").distinct(), t.select("sgg_cd").distinct(), "199411", "199503")


@query(f"{R_SERVED} SELECT c.*, p05, p25, p50, p75, p95 FROM (SELECT sgg_cd, count(*) AS n, 0::BIGINT AS cancelled, count(*) FILTER (is_jeonse AND area_m2 > 0 AND NOT is_outlier) AS priced FROM r_served GROUP BY 1) c LEFT JOIN {pct_sql('jeonse', 'sgg_cd', 'deposit_ppm2', Q5S)} p USING (sgg_cd)", "rent")
def rent_price_stats(spark, d):
    """Q28"""
    return serving.price_stats(_r_served(spark, d), ["sgg_cd"], "deposit_ppm2", F.col("is_jeonse") & (F.col("area_m2") > 0) & ~F.col("is_outlier"))


@query(f"{R_SERVED}, {_hist_sql('jeonse', 'deposit_ppm2')}", "rent")
def rent_histogram(spark, d):
    """Q28"""
    return serving.histogram(_r_served(spark, d), ["sgg_cd"], "deposit_ppm2", F.col("is_jeonse") & (F.col("area_m2") > 0) & ~F.col("is_outlier"))


@query("SELECT rent_id, deal_date, deposit_manwon FROM rent WHERE sgg_cd = '12001' AND monthly_rent_manwon = 0 ORDER BY deal_date DESC, rent_id DESC LIMIT 51", "rent")
def rent_page(spark, d):
    """Q29"""
    return serving.page(_r_served(spark, d), (F.col("sgg_cd") == "12001") & (F.col("monthly_rent_manwon") == 0), None, 50, "rent_id").select("rent_id", "deal_date", "deposit_manwon")


ROLL = "(SELECT sgg_cd, {0} AS v, unnest(range(no, no + 12)) AS no FROM (SELECT *, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no FROM {1}))"


@query(f"{SERVED} SELECT * FROM {pct_sql(ROLL.format('ppm2', 'priced'), 'sgg_cd, no', 'v', {'median': 0.5})}", "trade")
def rolling_median(spark, d):
    """Q31"""
    s = _served(spark, d)
    return serving.rolling_median(s.where(marts.priced(s)), ["sgg_cd"], "ppm2")


DONE = "SELECT DISTINCT sgg_cd, 'trade' AS source, deal_ym FROM trade UNION ALL SELECT DISTINCT sgg_cd, 'rent', deal_ym FROM rent"


def _done(spark, d):
    t, r = (view(spark, d, n).select("sgg_cd", F.lit(n).alias("source"), "deal_ym").distinct() for n in ("trade", "rent"))
    return t.unionByName(r)


COMPLETE = f"complete AS (SELECT sgg_cd, no FROM (SELECT sgg_cd, unnest(range(m, m + 12)) AS no FROM (SELECT *, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS m FROM ({DONE}))) GROUP BY ALL HAVING count(*) = 24)"


@query(f"--with {COMPLETE} SELECT * FROM complete", "trade", "rent")
def complete_windows(spark, d):
    """Q35, Q36"""
    return serving.complete_windows(_done(spark, d), 2)


@query(f"""{SERVED}{R_SERVED.replace("--with", ",")}, {COMPLETE}, t AS (SELECT sgg_cd, no, n, median FROM {pct_sql(ROLL.format("ppm2", "priced"), "sgg_cd, no", "v", {"median": 0.5})}), j AS (SELECT sgg_cd, no, n, median FROM {pct_sql(ROLL.format("deposit_ppm2", "jeonse"), "sgg_cd, no", "v", {"median": 0.5})})
SELECT sgg_cd, no, coalesce(t.n, 0) AS nt, coalesce(j.n, 0) AS nj, CASE WHEN c.sgg_cd IS NOT NULL THEN t.median END AS trade_median, CASE WHEN c.sgg_cd IS NOT NULL THEN j.median END AS jeonse_median,
CASE WHEN c.sgg_cd IS NOT NULL AND t.n >= 5 AND j.n >= 5 THEN round(j.median / nullif(t.median, 0) * 100, 1) END AS ratio_pct FROM t FULL JOIN j USING (sgg_cd, no) LEFT JOIN complete c USING (sgg_cd, no)""", "trade", "rent")
def jeonse_ratio(spark, d):
    """Q32-Q34"""
    t, r = _served(spark, d), _r_served(spark, d)
    return serving.jeonse_ratio(t.where(marts.priced(t)), r.where(F.col("is_jeonse") & (F.col("area_m2") > 0) & ~F.col("is_outlier")), serving.complete_windows(_done(spark, d), 2))


@query(f"""{R_SERVED}, j AS (SELECT complex_key, band, n AS nj, jeonse_median FROM {pct_sql(f"(SELECT *, {A_BAND} AS band FROM r_served WHERE is_jeonse AND area_m2 > 0)", "complex_key, band", "deposit_manwon::DOUBLE", {"jeonse_median": 0.5})}),
t AS (SELECT complex_key, band, n AS nt, trade_median FROM {pct_sql(f"(SELECT *, {A_BAND} AS band FROM trade WHERE NOT is_cancelled AND area_m2 > 0)", "complex_key, band", "price_manwon::DOUBLE", {"trade_median": 0.5})})
SELECT complex_key, band, nj, jeonse_median, nt, trade_median, CASE WHEN nj >= 3 AND nt >= 3 THEN round(jeonse_median * 100 / nullif(trade_median, 0), 1) END AS ratio_pct FROM j FULL JOIN t USING (complex_key, band)""", "trade", "rent")
def complex_rent_bands(spark, d):
    """Q37"""
    return serving.complex_rent_bands(_r_served(spark, d), view(spark, d, "trade"), ["complex_key"])


@query("SELECT strftime(max(deal_date), '%Y%m') AS latest FROM rent", "rent")
def latest_rent_month(spark, d):
    """Q38"""
    return serving.latest_month(_r_served(spark, d), "deal_date")


def _states(spark, d):
    """Two states of the trades: later, some are gone, some new, some missing, back or changed."""
    t = view(spark, d, "trade").select("trade_id", "price_manwon", "floor", (F.col("complex_no") % 17).alias("k"))
    missing = lambda on: F.when(F.col("k").isin(on), F.lit("1999-01-01").cast("date")).alias("missing_since")
    old = t.where("k <> 1").select("trade_id", "price_manwon", "floor", missing([4, 5]))
    new = t.where("k <> 2").select("trade_id", (F.col("price_manwon") + F.when(F.col("k") == 6, 1).otherwise(0)).alias("price_manwon"), "floor", missing([3, 5]))
    return old, new


@query("""--with t AS (SELECT trade_id, price_manwon, floor, complex_no % 17 AS k FROM trade)
SELECT trade_id, CASE k WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'missing' WHEN 4 THEN 'restored' ELSE 'updated' END AS change, CASE k WHEN 6 THEN 'price_manwon' ELSE '' END AS changed_fields,
price_manwon + CASE k WHEN 6 THEN 1 ELSE 0 END AS price_manwon FROM t WHERE k IN (1, 2, 3, 4, 6)""", "trade")
def state_diff(spark, d):
    """V4"""
    old, new = _states(spark, d)
    c = diff.diff_state(old, new, "trade_id", ["price_manwon", "floor", "missing_since"])
    return c.select("trade_id", "change", F.array_join("changed_fields", ",").alias("changed_fields"), "price_manwon")


@query("--with t AS (SELECT trade_id, price_manwon, complex_no % 17 AS k FROM trade) SELECT trade_id, price_manwon + CASE k WHEN 6 THEN 1 ELSE 0 END AS price_manwon FROM t WHERE k <> 2", "trade")
def replayed_state(spark, d):
    """T7, the replay law: the old state with the feed applied is the new state"""
    old, new = _states(spark, d)
    changes = diff.diff_state(old, new, "trade_id", ["price_manwon", "floor", "missing_since"])
    return diff.apply_changes(old, changes, "trade_id").select("trade_id", "price_manwon")


@query("--with f AS (SELECT trade_id, complex_no % 9 AS publish_id FROM trade) SELECT trade_id, publish_id, publish_id + 1 AS ordinal FROM f WHERE publish_id + 1 <= 6 AND (publish_id + 1, trade_id) > (2, '13') ORDER BY ordinal, trade_id LIMIT 101", "trade")
def change_feed_page(spark, d):
    """Q39, Q40"""
    changes = view(spark, d, "trade").select("trade_id", (F.col("complex_no") % 9).alias("publish_id"))
    return diff.feed_page(changes, spark.range(9).select(F.col("id").alias("publish_id"), (F.col("id") + 1).alias("ordinal")), (2, "13"), 6, 100)


VERSIONS = "SELECT concat('v', p_partkey) AS version, make_date(2024, 1, 1) + CAST(p_partkey AS INT) AS day, concat('b', p_partkey) AS publish_id, p_partkey % 400 = 10 AS snapshot_baseline, p_partkey FROM {}"


def _versions(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("deedflow_part")
    v = spark.sql(VERSIONS.format("deedflow_part")).withColumn("published_at", F.col("day").cast("timestamp"))
    files = v.select("publish_id", F.concat(F.lit("m"), F.col("p_partkey") % 7).alias("deal_ym"), F.concat(F.lit("f"), "p_partkey").alias("object_key"))
    return part or v, files


@query(f"WITH v AS ({VERSIONS.format('part')}) SELECT concat('m', p_partkey % 7) AS deal_ym, concat('f', max(p_partkey)) AS object_key FROM v WHERE p_partkey BETWEEN 10 AND 123 GROUP BY 1")
def files_for_version(spark, d):
    """Q41"""
    v, files = _versions(spark, d)
    return serving.files_for_version(v, files, "v123")


KEPT = f"WITH v AS (SELECT *, strftime(day::TIMESTAMP + INTERVAL 9 HOUR, '%Y%m') AS m, max(p_partkey) OVER () AS top, DATE '2024-01-01' + 480 AS now FROM ({VERSIONS.format('part')}) WHERE p_partkey >= 10), k AS (SELECT * FROM v QUALIFY day >= now - 30 OR p_partkey = top OR (row_number() OVER (PARTITION BY m ORDER BY p_partkey DESC) = 1 AND day >= now - 365))"


@query(f"{KEPT} SELECT version FROM k")
def kept_versions(spark, d):
    """Q42"""
    return serving.kept_versions(_versions(spark, d)[0], "2025-04-25").select("version")


@query(f"""{KEPT}, a AS (SELECT p.p_partkey, sum(CASE WHEN k.p_partkey IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY p.p_partkey) AS upto, k.p_partkey IS NOT NULL AS own, p.p_partkey >= 10 AS known FROM ({VERSIONS.format("part")}) p LEFT JOIN k USING (p_partkey)),
n AS (SELECT *, upto - own::INT AS before, coalesce(lead(upto - own::INT) OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey), max(upto) OVER ()) AS after FROM a)
SELECT concat('f', p_partkey) AS object_key FROM n WHERE NOT known OR after = before""")
def deletable_files(spark, d):
    """Q42"""
    v, files = _versions(spark, d)
    return serving.deletable_files(v, files, serving.kept_versions(v, "2025-04-25")).select("object_key")


USAGE = "SELECT concat('u', user_id % 50) AS client_id, event_type AS route, value AS latency, ts AS seen_at, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_id FROM {}"


def _usage(spark, d):
    return spark.sql(USAGE.format("{e}"), e=spark.read.parquet(f"{d}/events.parquet")).withColumns({"at": F.col("seen_at").cast("timestamp"), "rows": F.col("event_id") % 100})


@query(f"WITH u AS ({USAGE.format('events')}) SELECT client_id, strftime(seen_at + INTERVAL 9 HOUR, '%Y-%m-%d') AS period, count(*) AS calls, sum(event_id % 100)::BIGINT AS rows, count(*) FILTER (status >= 500) AS errors FROM u GROUP BY ALL")
def usage_daily(spark, d):
    """O14; the 95 % latency is approximate by definition and left out of the comparison"""
    return quality.usage_by(_usage(spark, d), "day").drop("p95_latency")


@query(f"WITH u AS ({USAGE.format('events')}) SELECT route, status, count(*) AS n FROM u WHERE status >= 500 GROUP BY ALL ORDER BY n DESC, route LIMIT 20")
def error_summary(spark, d):
    """O10"""
    return quality.error_summary(_usage(spark, d)).drop("last_at")


@query(f"WITH u AS ({USAGE.format('events')}), c AS (SELECT DISTINCT route, client_id FROM u), k AS (SELECT route, client_id FROM c QUALIFY row_number() OVER (PARTITION BY route ORDER BY client_id) <= 8) SELECT route, (SELECT count(*) FROM u WHERE u.route = k.route) AS n, string_agg(client_id, ',' ORDER BY client_id) AS samples FROM k GROUP BY route")
def error_groups(spark, d):
    """O9"""
    return quality.error_groups(_usage(spark, d), ["route"], "client_id").withColumn("samples", F.array_join("samples", ","))


CHECKS = "SELECT concat('a', user_id % 7) AS asset, event_type AS check_name, CASE WHEN user_id % 3 > 0 THEN concat('p', user_id % 11) END AS part, event_id % 4 <> 0 AS passed, ts AS seen_at, event_id FROM {}"


def _checks(spark, d):
    return spark.sql(CHECKS.format("{e}"), e=spark.read.parquet(f"{d}/events.parquet")).withColumns({"at": F.col("seen_at").cast("timestamp"), "check": F.col("check_name")})


@query(f"""WITH c AS ({CHECKS.format("events")}) SELECT event_id, EXISTS (SELECT 1 FROM c x WHERE x.asset = c.asset AND x.check_name = c.check_name AND x.part IS NOT DISTINCT FROM c.part AND x.passed AND x.seen_at > c.seen_at) AS resolved FROM c WHERE NOT passed AND seen_at >= TIMESTAMP '2024-01-20 00:00:00'""")
def failed_checks(spark, d):
    """O2, O12"""
    return quality.failed_checks(_checks(spark, d), "2024-01-20 00:00:00").select("event_id", "resolved")


@query(f"""WITH c AS ({CHECKS.format("events")}) SELECT asset, check_name, event_id FROM c QUALIFY row_number() OVER (PARTITION BY asset, check_name ORDER BY seen_at DESC, passed DESC, event_id DESC) = 1""")
def latest_checks(spark, d):
    """O4, O23"""
    return quality.latest_per(_checks(spark, d).select("asset", "check_name", "at", "passed", "event_id"), ["asset", "check_name"], "at").select("asset", "check_name", "event_id")


STATES = "SELECT concat(n_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0')) AS sgg_cd, concat(y * 100 + m, '') AS deal_ym, CASE (n_nationkey + m + y) % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'QUARANTINED' ELSE 'MERGED' END AS status FROM {0}, {1}"
GRID = "(SELECT o_custkey % 12 + 1 AS m, 1995 + o_custkey % 3 AS y FROM {0} GROUP BY 1, 2) g"


def _partition_states(spark, d):
    for n in ("nation", "orders"):
        spark.read.parquet(f"{d}/{n}.parquet").createOrReplaceTempView(f"deedflow_{n}")
    return spark.sql(STATES.format("deedflow_nation", GRID.format("deedflow_orders"))).withColumn("source", F.lit("trade"))


STATE_SQL = STATES.format("nation", GRID.format("orders"))


@query(f"SELECT status, count(*) AS n FROM ({STATE_SQL}) GROUP BY 1")
def status_counts(spark, d):
    """O1"""
    return quality.status_counts(_partition_states(spark, d)).drop("source")


@query(f"SELECT substr(sgg_cd, 1, 2) AS sido_cd, deal_ym, status, count(*) AS n FROM ({STATE_SQL}) GROUP BY ALL")
def status_grid(spark, d):
    """O3"""
    return quality.grid(_partition_states(spark, d))


@query(f"SELECT deal_ym, count(*) FILTER (status = 'MERGED') / 25.0::DOUBLE AS coverage FROM ({STATE_SQL}) GROUP BY 1 HAVING count(*) FILTER (status = 'MERGED') >= 25 * 0.4")
def complete_months(spark, d):
    """O16"""
    return quality.complete_months(_partition_states(spark, d), 25, 0.4)


@query(f"SELECT deal_ym, status, string_agg(sgg_cd, ',' ORDER BY sgg_cd) AS sgg FROM ({STATE_SQL}) WHERE status <> 'QUARANTINED' GROUP BY ALL")
def due_partitions(spark, d):
    """O17, T1"""
    s = _partition_states(spark, d).withColumn("next_due_at", F.lit("2024-01-01").cast("timestamp"))
    return quality.due(s, "2024-02-01").withColumn("sgg", F.array_join("sgg", ","))


@query(f"SELECT deal_ym, round(count(*) FILTER (status = 'MERGED') * 100.0::DOUBLE / count(*), 1) AS pct FROM ({STATE_SQL}) GROUP BY 1")
def completion(spark, d):
    """W7"""
    return quality.completion(_partition_states(spark, d), ["deal_ym"])


@query("""WITH r AS (SELECT l_orderkey % 13 AS g, (l_partkey % 3000)::BIGINT AS minutes FROM lineitem), k AS (SELECT g, minutes, count(*) AS w FROM r GROUP BY ALL), x AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY minutes) AS run, sum(w) OVER (PARTITION BY g) AS total FROM k)
SELECT g, sum(w)::BIGINT AS n, coalesce(sum(w) FILTER (minutes <= 60), 0)::BIGINT AS hour, coalesce(sum(w) FILTER (minutes > 60 AND minutes <= 1440), 0)::BIGINT AS day, coalesce(sum(w) FILTER (minutes > 1440), 0)::BIGINT AS later,
min(minutes) FILTER (run >= total * 0.5) AS p50, min(minutes) FILTER (run >= total * 0.9) AS p90, min(minutes) FILTER (run >= total * 0.99) AS p99 FROM x GROUP BY g""")
def publish_lag(spark, d):
    """O8"""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 13).alias("g"), (F.col("l_partkey") % 3000).alias("minutes"))
    return quality.publish_lag(rows, ["g"])


def _raw(spark, d):
    """Source strings of the trades, as a page of the source would hold them."""
    t = view(spark, d, "trade")
    text = {
        "sggCd": F.concat(F.lit(" "), "sgg_cd"), "umdNm": "umd_nm", "aptNm": F.concat(F.lit("Ａ동 "), "complex_key", F.lit("　")), "jibun": F.concat(F.lit("0"), F.col("complex_no").cast("string"), F.lit("-00"), (F.col("complex_no") % 7).cast("string")),
        "excluUseAr": F.col("area_m2").cast("string"), "dealYear": F.year("deal_date").cast("string"), "dealMonth": F.month("deal_date").cast("string"), "dealDay": F.dayofmonth("deal_date").cast("string"),
        "dealAmount": F.format_number("price_manwon", 0), "floor": F.coalesce(F.col("floor").cast("string"), F.lit(" ")), "buildYear": F.col("build_year").cast("string"), "cdealType": F.when(F.col("is_cancelled"), "O").otherwise(" "),
    }
    pairs = [x for k, v in text.items() for x in (F.lit(k), v if not isinstance(v, str) else F.col(v))]
    return t.select("trade_id", F.create_map(*pairs).alias("row"))


@query("SELECT trade_id, sgg_cd, deal_date, price_manwon, area_m2::DECIMAL(9, 4)::VARCHAR AS area_m2, floor::INT AS floor, is_cancelled, 0 AS n_errors, concat('Ａ동 ', complex_key) AS apt_nm FROM trade", "trade")
def typed_trades(spark, d):
    """P1-P9"""
    t = typing.typed_trades(_raw(spark, d))
    return t.select("trade_id", "sgg_cd", "deal_date", "price_manwon", F.col("area_m2").cast("string").alias("area_m2"), "floor", "is_cancelled", (F.size("errors") + F.size("missing")).alias("n_errors"), "apt_nm")


KEYED = """--with k AS (SELECT *, concat(sgg_cd, '|', lower(umd_nm), '|', complex_no, '-', complex_no % 7, '|a동', complex_key) AS place FROM trade),
h AS (SELECT trade_id, sgg_cd, deal_ym, concat('c_', substr(sha256(place), 1, 20)) AS complex_key, sha256(concat(place, '|', area_m2::DECIMAL(9, 4), '|', deal_date, '|', price_manwon, '|', coalesce(floor::INT::VARCHAR, ''))) AS trade_key,
substr(sha256(concat(CASE WHEN is_cancelled THEN 'True' ELSE 'False' END, '|||||||', '|', build_year, '|')), 1, 32) AS attr_hash FROM k)"""


@query(KEYED + " SELECT trade_id, complex_key, trade_key, attr_hash FROM h", "trade")
def keyed_trades(spark, d):
    """K1-K9"""
    k = keys.keyed_trades(typing.typed_trades(_raw(spark, d)).withColumnRenamed("trade_id", "source_id"))
    return k.select(F.col("source_id").alias("trade_id"), "complex_key", "trade_key", "attr_hash")


TWINS = """--with k AS (SELECT *, concat(sgg_cd, '|', lower(umd_nm), '||') AS place FROM trade),
h AS (SELECT sgg_cd, deal_ym, sha256(concat(place, '|20.0000|', deal_date, '|1000|')) AS trade_key, substr(sha256(concat(CASE WHEN is_cancelled THEN 'True' ELSE 'False' END, '|||||||', '|', build_year, '|')), 1, 32) AS attr_hash FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY sgg_cd, deal_ym, trade_key ORDER BY attr_hash) - 1 AS dup_seq FROM h), i AS (SELECT *, concat(sgg_cd, '-', deal_ym, '-', substr(trade_key, 1, 16), '-', dup_seq) AS trade_id FROM n)"""


def _twins(spark, d):
    """Trades of one size and price, that only place, day and attributes tell apart."""
    same = {"aptNm": " ", "jibun": " ", "excluUseAr": "20", "dealAmount": "1,000", "floor": " "}
    row = F.map_concat(F.map_filter("row", lambda k, _: ~k.isin(*same)), F.create_map(*(F.lit(x) for kv in same.items() for x in kv)))
    return keys.keyed_trades(typing.typed_trades(_raw(spark, d).select(row.alias("row"))))


@query(TWINS + " SELECT sgg_cd, deal_ym, trade_key, attr_hash, dup_seq::INT AS dup_seq, trade_id FROM i", "trade")
def duplicate_numbers(spark, d):
    """The rank of equal keys by their attributes, and the public id"""
    return _twins(spark, d).select("sgg_cd", "deal_ym", "trade_key", "attr_hash", "dup_seq", "trade_id")


@query(TWINS + " SELECT count(DISTINCT trade_key) AS duplicate_groups FROM i WHERE dup_seq > 0", "trade")
def duplicate_groups(spark, d):
    """K12"""
    return keys.duplicate_groups(_twins(spark, d))


@query(TWINS + ", x AS (SELECT trade_id, deal_ym, sgg_cd, dup_seq FROM i UNION ALL SELECT concat(trade_id, 'x'), NULL, sgg_cd, dup_seq FROM i) SELECT trade_id, deal_ym AS month, sgg_cd, substr(trade_id, 7, 6) AS ym FROM x", "trade")
def id_months(spark, d):
    """Of well-formed and malformed ids"""
    ids = _twins(spark, d).select("trade_id")
    ids = ids.unionByName(ids.select(F.concat("trade_id", F.lit("x")).alias("trade_id")))
    sgg, ym = serving.scope_of(F.col("trade_id"))
    return ids.select("trade_id", keys.id_month(F.col("trade_id")).alias("month"), sgg.alias("sgg_cd"), ym.alias("ym"))


def _history(spark, d):
    """A month history and an observation of it: keys, some changed, some gone, some new; the last district is not observed."""
    t = view(spark, d, "trade").select(F.col("trade_id").alias("trade_key"), F.lit(0).alias("dup_seq"), "sgg_cd", "price_manwon", (F.col("complex_no") % 5).alias("k"))
    at = lambda s: F.lit(s).cast("timestamp")
    null = lambda t: F.lit(None).cast(t)
    hash_ = lambda c: F.sha2(c.cast("string"), 256)
    history = t.where("k <> 1").select("trade_key", "dup_seq", "sgg_cd", hash_(F.col("price_manwon")).alias("attr_hash"), "price_manwon", F.lit(1).alias("version"), at("2024-01-01").alias("valid_from"), null("timestamp").alias("valid_to"), F.lit(True).alias("is_current"), F.lit("i1").alias("ingest_id"), F.lit("i1").alias("last_seen_ingest"), at("2024-01-01").alias("last_seen_at"), null("timestamp").alias("missing_since"), null("int").alias("missing_seq"))
    price = F.col("price_manwon") + F.when(F.col("k") == 2, 1).otherwise(0)
    stage = t.where("k <> 3").where("sgg_cd <> '15023'").withColumn("price_manwon", price).withColumn("attr_hash", hash_(F.col("price_manwon"))).select("trade_key", "dup_seq", "sgg_cd", "attr_hash", "price_manwon")
    parts = t.where("sgg_cd <> '15023'").select("sgg_cd").distinct().withColumns({"ingest_id": F.lit("i2"), "seen_at": at("2024-02-01"), "fetch_seq": F.lit(2)})
    return history, stage, parts


@query("""--with t AS (SELECT *, complex_no % 5 AS k, sgg_cd <> '15023' AS seen FROM trade)
SELECT trade_id AS trade_key, 1 AS version, price_manwon, NOT (seen AND k = 2) AS is_current, CASE WHEN seen AND k = 2 THEN '2024-02-01' END AS closed, CASE WHEN seen AND k = 3 THEN 2 END AS missing_seq, CASE WHEN seen AND k IN (0, 4) THEN 'i2' ELSE 'i1' END AS last_seen_ingest FROM t WHERE k <> 1
UNION ALL SELECT trade_id, 2, price_manwon + 1, true, NULL, NULL, 'i2' FROM t WHERE seen AND k = 2 UNION ALL SELECT trade_id, 1, price_manwon, true, NULL, NULL, 'i2' FROM t WHERE seen AND k = 1""", "trade")
def history_merge(spark, d):
    """M1-M4"""
    history, stage, parts = _history(spark, d)
    m = scd2.merge_history(history, stage, parts, "trade_key", ["price_manwon"])
    return m.select("trade_key", "version", "price_manwon", "is_current", F.date_format("valid_to", "yyyy-MM-dd").alias("closed"), "missing_seq", "last_seen_ingest")


@query("""--with s AS (SELECT complex_key, min(sgg_cd) AS sgg_cd, min(deal_date) AS first_seen, max(build_year) AS build_year, CASE WHEN count(DISTINCT complex_no % 3) = 1 THEN min(complex_no % 3)::VARCHAR END AS apt_seq, min(complex_no) AS no FROM trade GROUP BY 1)
SELECT complex_key, sgg_cd, CASE WHEN no % 2 = 0 THEN least(first_seen, DATE '1996-01-01') ELSE first_seen END AS first_seen, CASE WHEN no % 4 = 0 THEN 1900 ELSE build_year END AS build_year, apt_seq FROM s""", "trade")
def complex_merge(spark, d):
    """M5-M7"""
    t = view(spark, d, "trade").select("complex_key", "complex_no", "sgg_cd", "umd_nm", F.lit("1").alias("jibun"), F.lit("a").alias("apt_nm"), "build_year", F.lit(None).cast("boolean").alias("land_leasehold"), "deal_date", (F.col("complex_no") % 3).cast("string").alias("apt_seq"))
    half = t.where("complex_no % 2 = 0")
    dim = half.groupBy("complex_key").agg(F.min("sgg_cd").alias("sgg_cd"), F.min("umd_nm").alias("umd_nm"), F.min("jibun").alias("jibun"), F.min("apt_nm").alias("apt_nm"), F.max(F.when(F.col("complex_no") % 4 == 0, 1900)).alias("build_year"), F.bool_or("land_leasehold").alias("land_leasehold"), F.lit("1996-01-01").cast("date").alias("first_seen"), F.lit(None).cast("string").alias("apt_seq"))
    return scd2.merge_complexes(dim, t).select("complex_key", "sgg_cd", "first_seen", "build_year", "apt_seq")


@query("""--with o AS (SELECT sgg_cd, deal_ym, price_manwon, complex_no, umd_nm FROM trade), n AS (SELECT sgg_cd, deal_ym, price_manwon, complex_no, concat(umd_nm, CASE WHEN complex_no % 20 = 0 THEN '-new' ELSE '' END) AS umd_nm FROM o)
SELECT n.sgg_cd, o.umd_nm AS old_nm, n.umd_nm AS new_nm, count(*) AS n FROM n JOIN o USING (sgg_cd, deal_ym, price_manwon, complex_no) WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.sgg_cd = n.sgg_cd AND x.deal_ym = n.deal_ym AND x.price_manwon = n.price_manwon AND x.complex_no = n.complex_no AND x.umd_nm = n.umd_nm) GROUP BY ALL""", "trade")
def renamed_places(spark, d):
    """V8"""
    old = view(spark, d, "trade").select("sgg_cd", "deal_ym", "price_manwon", "complex_no", "umd_nm")
    new = old.withColumn("umd_nm", F.concat("umd_nm", F.when(F.col("complex_no") % 20 == 0, "-new").otherwise("")))
    return checks.renamed(new, old, ["sgg_cd", "deal_ym", "price_manwon", "complex_no"])


@query(f"{SERVED}, m AS ({ROLLUP}), g AS (SELECT region_id, strftime(x, '%Y%m') AS deal_ym FROM (SELECT DISTINCT region_id FROM m), unnest(generate_series(DATE '1994-10-01', DATE '1995-06-01', INTERVAL 1 MONTH)) u(x)) SELECT region_id, deal_ym, coalesce(trades, 0) AS trades FROM g LEFT JOIN m USING (region_id, deal_ym)", "trade")
def calendar_fill(spark, d):
    """W3, W10"""
    return serving.calendar_fill(mart(spark, d, "rollup_month"), "region_id", "199410", "199506", ["trades"])


@query(f"{SERVED}, m AS ({ROLLUP}), v AS (SELECT trades, row_number() OVER (ORDER BY trades) - 1 AS r, count(*) OVER () AS n FROM m) SELECT DISTINCT trades AS edge FROM v WHERE r IN (floor(n / 6), floor(2 * n / 6), floor(3 * n / 6), floor(4 * n / 6), floor(5 * n / 6))", "trade")
def quantile_edges(spark, d):
    """W1"""
    return quality.quantile_edges(mart(spark, d, "rollup_month"), "trades", 6)


@query("""WITH e AS (SELECT user_id % 20 AS client_id, ts AS seen_at, event_id, epoch_us(ts) AS us FROM events), w AS (SELECT *, us // 3600000000 AS w, (us % 3600000000) / 3600000000.0::DOUBLE AS frac FROM e), c AS (SELECT client_id, w + 1 AS w, count(*) AS prev FROM w GROUP BY ALL)
SELECT event_id, coalesce(prev, 0) * (1 - frac) + count(*) OVER (PARTITION BY client_id, w ORDER BY seen_at) AS estimate FROM w LEFT JOIN c USING (client_id, w)""")
def sliding_rate(spark, d):
    """C5, T6"""
    calls = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("client_id"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    return control.sliding_rate(calls, window_s=3600).select("event_id", "estimate")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    """an extra: tumbling windows over events"""
    from deedflow.streaming.ingest import windowed_counts as counts

    return counts(spark.read.parquet(f"{d}/events.parquet"), "1 hour", by=["event_type"])


@query()
def hedonic_index(spark, d):
    """H1-H6, H8: nation and provinces; tested against a dense least-squares fit"""
    s = _served(spark, d)
    wide = s.where(marts.priced(s)).withColumn("region_id", F.explode(F.array("sido_cd", F.lit("00"))))
    return hedonic.fit_index(wide)


@query(f"""{SERVED}, m AS (SELECT sgg_cd AS region_id, deal_ym, median_ppm2 AS value, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no FROM ({_month_sql("served", "priced", "sgg_cd")}) WHERE median_ppm2 IS NOT NULL)
SELECT a.region_id, a.deal_ym, a.value / b.value - 1 AS change FROM m a JOIN m b ON a.region_id = b.region_id AND a.no = b.no + 1""", "trade")
def monthly_change(spark, d):
    """H6"""
    return hedonic.monthly_change(mart(spark, d, "region_month").where("median_ppm2 is not null").select(F.col("sgg_cd").alias("region_id"), "deal_ym", F.col("median_ppm2").alias("value")))


@query("SELECT p_partkey, lower(replace(replace(p_name, ' ', ''), chr(9), '')) AS norm FROM part")
def normalised_names(spark, d):
    """K1"""
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", keys.norm_text(F.col("p_name")).alias("norm"))


@query("WITH h AS (SELECT l_returnflag AS g, l_linenumber AS v, count(*) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v) AS run, sum(w) OVER (PARTITION BY g) AS t FROM h) SELECT g, max(t)::BIGINT AS total, min(v) FILTER (run >= t * 0.25) AS p25, min(v) FILTER (run >= t * 0.75) AS p75 FROM r GROUP BY g")
def nearest_ranks(spark, d):
    """O7"""
    h = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("g"), "l_linenumber").agg(F.count(F.lit(1)).alias("w"))
    return nearest_rank(h, ["g"], "l_linenumber", "w", {"p25": 0.25, "p75": 0.75})


@query(f"""{SERVED}, m AS (SELECT *, substr(deal_ym, 1, 4)::INT * 12 + substr(deal_ym, 5, 2)::INT AS no FROM ({_month_sql("served", "priced", "sgg_cd")}) WHERE deal_ym <= '200108')
SELECT a.sgg_cd, a.deal_ym, a.median_ppm2, round((a.median_ppm2 - y.median_ppm2) * 100.0::DOUBLE / nullif(y.median_ppm2, 0), 2) AS median_ppm2_yoy FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sgg_cd ORDER BY deal_ym DESC) = 1) a LEFT JOIN m y ON a.sgg_cd = y.sgg_cd AND y.no = a.no - 12""", "trade")
def latest_quote(spark, d):
    """W4, Q26"""
    return serving.latest_quote(mart(spark, d, "region_month"), "sgg_cd", "2001-10-05")


@query(f"{SERVED}, m AS (SELECT * FROM ({_month_sql('served', 'priced', 'sgg_cd')}) QUALIFY row_number() OVER (PARTITION BY sgg_cd ORDER BY deal_ym DESC) <= 12) SELECT sgg_cd, sum(trades)::BIGINT AS trades, sum(priced)::BIGINT AS priced FROM m GROUP BY 1", "trade")
def trailing_stats(spark, d):
    """W4"""
    return serving.trailing(mart(spark, d, "region_month"), "sgg_cd")


@query("SELECT trade_id, coalesce(floor, -1) AS floor, build_year, coalesce(cancel_date, DATE '1970-01-01') AS cancel_date FROM trade", "trade")
def published_rows(spark, d):
    """V3"""
    import datetime as dt

    return serving.published(view(spark, d, "trade"), {"trade_id": None, "floor": -1, "build_year": None, "cancel_date": dt.date(1970, 1, 1)})


@query("""--with t AS (SELECT *, complex_no % 5 AS k, sgg_cd <> '15023' AS seen FROM trade),
cur AS (SELECT trade_id, sgg_cd, price_manwon + CASE WHEN seen AND k = 2 THEN 1 ELSE 0 END AS price, seen AND k = 3 AS missing, seen FROM t WHERE k <> 1 OR seen),
kept AS (SELECT * FROM cur WHERE price % 97 <> 0), twice AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE price % 89 = 0),
a AS (SELECT sgg_cd, count(*) FILTER (k <> 3) AS staged FROM t WHERE seen GROUP BY 1), o AS (SELECT sgg_cd, count(*) FILTER (NOT missing) AS observed FROM twice WHERE seen GROUP BY 1)
SELECT 'dup_current' AS check_name, count(*) AS failed, (SELECT count(*) FROM kept)::DOUBLE AS metric FROM kept WHERE price % 89 = 0
UNION ALL SELECT 'stage_as_observed', count(*) FILTER (staged <> coalesce(observed, 0)), count(*) FROM a LEFT JOIN o USING (sgg_cd)
UNION ALL SELECT 'missing_3_times', count(*) FILTER (price % 2 = 0), count(*) FROM twice WHERE missing
UNION ALL SELECT 'duplicate_groups', 0, 0""", "trade")
def merge_checks(spark, d):
    """M9, on a merge that lost rows and doubled others"""
    return checks.post_merge(*_damaged(spark, d), "trade_key").withColumnRenamed("check", "check_name")


def _damaged(spark, d):
    """A merged history without the rows of some prices and with those of others twice, its stage and districts."""
    history, stage, parts = _history(spark, d)
    merged = scd2.merge_history(history, stage, parts, "trade_key", ["price_manwon"]).where("price_manwon % 97 <> 0 or not is_current")
    # Rows of even prices count as missing since the first observation, a third one having followed the second.
    merged = merged.withColumn("missing_seq", F.when(F.col("missing_since").isNotNull() & (F.col("price_manwon") % 2 == 0), F.col("missing_seq") - 1).otherwise(F.col("missing_seq")))
    twice = merged.unionByName(merged.where("is_current and price_manwon % 89 = 0"))
    return twice, stage, parts.withColumn("fetch_seq", F.lit(3))


@query("""--with t AS (SELECT *, complex_no % 5 AS k, sgg_cd <> '15023' AS seen FROM trade),
kept AS (SELECT * FROM (SELECT sgg_cd, price_manwon + CASE WHEN seen AND k = 2 THEN 1 ELSE 0 END AS price, seen AND k = 3 AS missing, seen FROM t WHERE k <> 1 OR seen) WHERE price % 97 <> 0),
a AS (SELECT sgg_cd, count(*) FILTER (k <> 3) AS staged FROM t WHERE seen GROUP BY 1), o AS (SELECT sgg_cd, sum(CASE WHEN price % 89 = 0 THEN 2 ELSE 1 END) AS observed FROM kept WHERE seen AND NOT missing GROUP BY 1)
SELECT 'dup_current' AS check_name, count(*) AS failed FROM kept WHERE price % 89 = 0 UNION ALL SELECT 'stage_as_observed', count(*) FILTER (staged <> coalesce(observed, 0)) FROM a LEFT JOIN o USING (sgg_cd)""", "trade")
def month_verification(spark, d):
    """The blocking checks again, on the same damaged month"""
    return checks.verify_month(*_damaged(spark, d), "trade_key").select(F.col("check").alias("check_name"), "failed")


WAITS = "SELECT DISTINCT concat(year(l_shipdate) * 100 + month(l_shipdate), '') AS deal_ym, CAST(l_shipdate AS DATE) AS day FROM {}"


@query(f"""WITH c AS ({WAITS.format("lineitem")}), p AS (SELECT DISTINCT deal_ym, last_day(day) + n AS day FROM c, unnest([-20, -9, 3]) u(n)), s AS (SELECT *, lag(day) OVER (PARTITION BY deal_ym ORDER BY day) AS prev FROM p)
SELECT s.deal_ym, s.day AS published_on, count(*) AS n, sum(date_diff('day', c.day, s.day) * 1440)::BIGINT AS minutes FROM s JOIN c ON s.deal_ym = c.deal_ym AND c.day <= s.day AND (prev IS NULL OR c.day > prev) GROUP BY ALL""")
def publish_waits(spark, d):
    """Minutes from each change to the publish that took it in"""
    days = spark.sql(WAITS.format("{l}"), l=spark.read.parquet(f"{d}/lineitem.parquet"))
    publishes = days.select("deal_ym", F.explode(F.array(*(F.date_add(F.last_day("day"), n).cast("timestamp") for n in (-20, -9, 3)))).alias("published_at")).distinct()
    rows = quality.lag_rows(publishes, days.select("deal_ym", F.col("day").cast("timestamp").alias("changed_at")))
    return rows.groupBy("deal_ym", F.to_date("published_at").alias("published_on")).agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))


from deedflow import queries_ops as _ops  # noqa: E402, F401  registers the rest
