"""Domain-shaped views of the driver's star schema. One text defines each view, for Spark and for the SQL oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Only syntax that Spark SQL and DuckDB read alike.
VIEWS = {
    "trade": """
SELECT concat(r_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0'), '-', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', dup_seq) AS trade_id,
       concat(r_regionkey + 11, '') AS sido_cd, concat(r_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0')) AS sgg_cd,
       deal_date, concat(year(deal_date) * 100 + month(deal_date), '') AS deal_ym, l_partkey AS complex_no, concat('c_', l_partkey) AS complex_key, c_mktsegment AS umd_nm,
       CAST(floor(l_extendedprice) AS BIGINT) AS price_manwon, CASE WHEN l_quantity = 1 THEN 0.0E0 ELSE l_quantity * 4 END AS area_m2,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 4 - 3 END AS floor, CAST(1970 + l_partkey % 50 AS INT) AS build_year,
       l_returnflag = 'R' AS is_cancelled, CASE WHEN l_returnflag = 'R' THEN CAST(deal_date + INTERVAL 20 DAY AS DATE) END AS cancel_date, dup_seq
FROM (SELECT *, CAST(l_shipdate AS DATE) AS deal_date,
             row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS dup_seq FROM {lineitem}) l
JOIN {orders} o ON l_orderkey = o_orderkey JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
""",
    "rent": """
SELECT concat('r', r_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0'), '-', o_orderkey) AS rent_id,
       concat(r_regionkey + 11, '') AS sido_cd, concat(r_regionkey + 11, lpad(concat(n_nationkey, ''), 3, '0')) AS sgg_cd,
       CAST(o_orderdate AS DATE) AS deal_date, concat(year(o_orderdate) * 100 + month(o_orderdate), '') AS deal_ym, concat('c_', o_custkey % 2000) AS complex_key,
       CAST(floor(o_totalprice) AS BIGINT) AS deposit_manwon, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END AS monthly_rent_manwon,
       CASE o_orderstatus WHEN 'F' THEN 'renewal' WHEN 'O' THEN 'new' END AS contract_type, CASE WHEN o_orderkey % 7 = 0 THEN 'used' END AS use_rr_right,
       CASE WHEN o_custkey % 150 = 0 THEN 0.0E0 ELSE 20.0E0 + o_custkey % 150 END AS area_m2
FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
""",
    "version": """
SELECT concat(user_id, '') AS trade_id, concat(user_id % 5 + 11, lpad(concat(user_id % 25, ''), 3, '0')) AS sgg_cd, CAST(row_number() OVER w AS INT) AS version,
       ts AS valid_from, lead(ts) OVER w AS valid_to, event_type AS state, floor(value) AS amount, event_type = 'error' AS is_cancelled, CAST(ts AS DATE) AS seen_on
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})


def oracle(sql: str, *names: str) -> str:
    """sql over the named views."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names) + ("," if sql.lstrip().startswith("--with") else "") + " " + sql.replace("--with", "")
