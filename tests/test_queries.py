"""Registered queries: each agrees with its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from deedflow.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    out = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", ["merge_checks", "month_verification", "bronze_checks", "state_transitions", "data_checks", "keyed_rents", "feed_errors", "error_log", "index_summary", "region_month", "rent_rollup_month", "source_latency", "histogram", "district_summary", "jeonse_ratio", "deletable_files", "failed_checks", "keyed_trades", "history_merge", "state_diff"])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_every_query_has_sql_but_the_index():
    assert set(QUERIES) - set(ORACLE) == {"hedonic_index"} and set(ORACLE) <= set(QUERIES)


def test_renamed_places_compares_the_whole_table(spark, duck, monkeypatch):
    from deedflow import queries

    seen, plain_renamed = [], queries.checks.renamed
    monkeypatch.setattr(queries.checks, "renamed", lambda new, old, *a: seen.extend([new.count(), old.count()]) or plain_renamed(new, old, *a))
    df = QUERIES["renamed_places"](spark, SF)
    assert seen == [queries.view(spark, SF, "trade").count()] * 2
    cols = sorted(df.columns)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE['renamed_places']})").fetchall())
