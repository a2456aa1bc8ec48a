"""Parsing, keys, values, percentiles, checks, diffs and control rules on literal cases."""

import datetime as dt
import hashlib
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedflow.functions import keys, typing, values
from deedflow.operators import checks, diff
from deedflow.operators.percentile import exact_percentiles, nearest_rank
from deedflow.plans import control, quality, regions, serving


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("235,000", 235000), (" 1 ", 1), ("", None), ("　", None), ("-5", None), ("1.5", None), ("x", None), (None, None), ("99999999999999999999", None)])
def test_amount(spark, text, want):
    assert one(spark, typing.amount, text) == want


def test_signed_amount_integer_and_area(spark):
    assert one(spark, lambda c: typing.amount(c, True), "-19,870") == -19870
    assert one(spark, typing.integer, "-3") == -3 and one(spark, typing.integer, "1,000") is None
    assert str(one(spark, typing.area, "84.98765")) == "84.9877" and one(spark, typing.area, "x") is None


@pytest.mark.parametrize(("text", "want"), [("25.11.27", dt.date(2025, 11, 27)), ("06.1.2", dt.date(2006, 1, 2)), ("24.2.30", None), ("2024.1.1", None), (" ", None), (None, None)])
def test_short_date(spark, text, want):
    assert one(spark, typing.short_date, text) == want


def trade(**over):
    row = {"sggCd": "11110", "umdNm": "사직동", "aptNm": "광화문 Ａ", "jibun": "0202-0003", "excluUseAr": "84.98", "dealYear": "2024", "dealMonth": "7", "dealDay": "3", "dealAmount": "235,000", "floor": "3", "buildYear": "2008", "cdealType": " ", "cdealDay": " ", "landLeaseholdGbn": "N"}
    return row | over


def test_typed_trade(spark):
    rows = [trade(), trade(cdealType="O", cdealDay="24.8.1", landLeaseholdGbn="Y"), trade(dealAmount="abc", landLeaseholdGbn=" "), trade(umdNm=" "), trade(dealDay="31", dealMonth="2")]
    got = typing.typed_trades(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, row map<string,string>")).orderBy("k").collect()
    assert got[0]["price_manwon"] == 235000 and got[0]["land_leasehold"] is False and not got[0]["is_cancelled"] and got[0]["errors"] == []
    assert got[1]["is_cancelled"] and got[1]["cancel_date"] == dt.date(2024, 8, 1) and got[1]["land_leasehold"] is True
    assert got[2]["errors"] == ["dealAmount"] and got[2]["land_leasehold"] is None
    assert got[3]["missing"] == ["umdNm"] and got[4]["errors"] == ["dealDay"] and got[4]["deal_date"] is None


def test_typed_rent(spark):
    row = {"sggCd": "11110", "umdNm": "a", "aptNm": "b", "dealYear": "2024", "dealMonth": "1", "dealDay": "2", "deposit": "10,000", "monthlyRent": "0", "preDeposit": "-19,870", "contractType": " "}
    got = typing.typed_rents(spark.createDataFrame([(row,)], "row map<string,string>")).first()
    assert (got["deposit_manwon"], got["monthly_rent_manwon"], got["pre_deposit_manwon"], got["contract_type"]) == (10000, 0, -19870, None)


def test_schema_version(spark):
    df = spark.createDataFrame([("a", {"sggCd": "1"}), ("b", {"aptSeq": "1"}), ("c", {"zzz": "1"})], "p string, row map<string,string>")
    assert {r["p"]: r["schema_ver"] for r in typing.schema_version(df, "row", ["p"], {1: typing.TRADE_V1, 2: typing.TRADE_V2}).collect()} == {"a": 1, "b": 2, "c": None}


@pytest.mark.parametrize("text", ["광화문 Ａ", " A\t b", "ﬁ①", "é", "é", None, "", "㈜ 한"])
def test_names(spark, text):
    plain = unicodedata.normalize("NFKC", text or "")
    assert one(spark, keys.norm_text, text) == "".join(plain.split()).lower()
    assert one(spark, keys.display_text, text) == " ".join(plain.split())


@pytest.mark.parametrize(("lot", "want"), [("0202-0003", "202-3"), (" 산 012 ", "산12"), ("0-00", "0-0"), ("100", "100"), (None, "")])
def test_lot(spark, lot, want):
    assert one(spark, keys.norm_lot, lot) == want


def keyed(spark, rows, aliases=None):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, row map<string,string>")
    return {r["k"]: r for r in keys.keyed_trades(typing.typed_trades(df), aliases).collect()}


def test_keys_do_not_depend_on_order_or_spelling(spark):
    rows = [trade(), trade(jibun="202-3", aptNm="광화문A"), trade(buildYear="1999"), trade(floor="4")]
    got = keyed(spark, rows)
    assert got[0]["trade_key"] == got[1]["trade_key"] == got[2]["trade_key"] != got[3]["trade_key"]
    assert sorted(got[k]["dup_seq"] for k in (0, 1, 2)) == [0, 1, 2] and got[3]["dup_seq"] == 0
    again = keyed(spark, rows[::-1])
    assert {(r["attr_hash"], r["dup_seq"]) for r in got.values()} == {(r["attr_hash"], r["dup_seq"]) for r in again.values()}
    want = hashlib.sha256("11110|사직동|202-3|광화문a".encode()).hexdigest()[:20]
    assert got[0]["complex_key"] == f"c_{want}" and got[3]["trade_id"] == f"11110-202407-{got[3]['trade_key'][:16]}-0"
    assert spark.createDataFrame([(got[3]["trade_id"],)], "c string").select(keys.id_month(F.col("c"))).first()[0] == "202407"
    assert one(spark, keys.id_month, "11110-202413-0123456789abcdef-0") is None


def test_aliases_keep_old_keys(spark):
    aliases = spark.createDataFrame([("11110", "새들읍", "새들면")], "sgg_cd string, new_nm string, old_nm string")
    old, new = keyed(spark, [trade(umdNm="새들면")], aliases)[0], keyed(spark, [trade(umdNm="새들읍")], aliases)[0]
    assert old["trade_key"] == new["trade_key"] and new["umd_nm"] == "새들읍"


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 100, 7.0])) for _ in range(691)] + [("c", 4.0), ("d", None)]
    got = {r["g"]: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p1": 0.001, "p50": 0.5, "p95": 0.95}).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g]
        assert got[g]["n"] == len(v)
        for k, p in (("p1", 0.1), ("p50", 50), ("p95", 95)):
            assert got[g][k] == pytest.approx(np.percentile(v, p), abs=1e-12)
    assert "d" not in got


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 9, 1)], "g string, v int, n int")
    r = nearest_rank(df, ["g"], "v", "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    assert (r["total"], r["p50"], r["p90"], r["p99"]) == (10, 1, 2, 9)


@pytest.mark.parametrize(("c", "area", "floor"), [(3, 0, 0), (40, 1, 3), (10, 0, 1), (60, 2, 3), (85, 3, 3), (135, 4, 3), (20, 0, 2)])
def test_bands(spark, c, area, floor):
    assert one(spark, lambda x: values.band(x, values.AREA_EDGES, False), c, "int") == area
    assert one(spark, lambda x: values.band(x, values.FLOOR_EDGES, True), c, "int") == floor


def test_nice_width_and_initials(spark):
    width = lambda lo, hi: spark.range(1).select(values.nice_width(F.lit(lo), F.lit(hi))).first()[0]
    assert width(0.0, 160.0) == 10 and width(0.0, 32.0) == 2 and width(0.0, 40.0) == 2.5 and width(0.0, 48.0) == 5 and width(1.0, 1.0) == 1
    assert one(spark, values.initials, "강남 Gu") == "ㄱㄴ Gu"


def test_month_filter_refuses_anything_else():
    for bad in ("202413", "2024-1", "202401' or 1", ""):
        with pytest.raises(ValueError, match="month"):
            values.month_filter(bad)


def test_cursor_round_trip():
    q, secret = {"sgg": "11110"}, b"k"
    text = values.encode_cursor(["2024-01-01", "x"], q, secret)
    assert values.decode_cursor(text, q, secret) == ["2024-01-01", "x"]
    for bad, query in ((text, {"sgg": "1"}), (text[:-4] + "AAAA", q), ("!", q)):
        with pytest.raises(ValueError, match="cursor"):
            values.decode_cursor(bad, query, secret)


def test_feed_window_rules(spark):
    day = lambda k: dt.datetime(2026, 1, k)
    v = spark.createDataFrame([(f"v{k}", day(k), f"p{k}" if k != 4 else None, k == 2) for k in range(1, 8)], "version string, published_at timestamp, publish_id string, snapshot_baseline boolean")
    upper, rows = diff.feed_window(v, "v3", "v6", "2026-01-08", 90)
    assert upper == "v6" and sorted(r["version"] for r in rows.collect()) == ["v5", "v6"] and diff.feed_window(v, "v7", None, "2026-01-08", 90)[1].count() == 0
    for since, until, days, code, oldest in (("zz", None, 90, "VERSION_NOT_FOUND", None), ("v1", None, 90, "CHANGES_EXPIRED", "v2"), ("v3", None, 3, "CHANGES_EXPIRED", "v5"), ("v5", "v4", 90, "INVALID_CURSOR", None), ("v5", "zz", 90, "INVALID_CURSOR", None)):
        with pytest.raises(diff.FeedError) as e:
            diff.feed_window(v, since, until, "2026-01-08", days)
        assert (e.value.code, e.value.oldest) == (code, oldest)


def test_percentiles_of_uneven_groups(spark):
    """All equal, far outliers, negative values, a null group, and one value."""
    rng = random.Random(6)
    groups = {"same": [3.25] * 50, "far": [rng.random() for _ in range(400)] + [1e12, -1e12], "neg": [-rng.random() * 7 for _ in range(333)], None: [rng.choice([1.0, 2.0, 1e-9]) for _ in range(77)], "one": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    pcts = {"lo": 0.001, "p25": 0.25, "p50": 0.5, "hi": 0.999}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", pcts, wide=True).collect()}
    for other in (exact_percentiles(df, ["g"], "v", pcts), exact_percentiles(df, ["g"], "v", pcts, wide=True, step=0.125)):
        assert {r["g"]: r for r in other.collect()} == got
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for k, p in (("lo", 0.001), ("p25", 0.25), ("p50", 0.5), ("hi", 0.999)):
            at = (len(vs) - 1) * p
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert got[g][k] == lo + (at - math.floor(at)) * (hi - lo) and got[g]["n"] == len(vs)


def test_diff_rules(spark):
    schema = "id string, p int, missing_since date"
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([("gone", 1, None), ("same", 1, None), ("up", 1, None), ("lost", 1, None), ("back", 1, day), ("both", 1, None)], schema)
    new = spark.createDataFrame([("new", 1, None), ("same", 1, None), ("up", 2, None), ("lost", 1, day), ("back", 1, None), ("both", 2, day)], schema)
    got = {r["id"]: (r["change"], r["changed_fields"], r["p"]) for r in diff.diff_state(old, new, "id", ["p", "missing_since"]).collect()}
    assert got == {"gone": ("removed", [], 1), "new": ("added", [], 1), "up": ("updated", ["p"], 2), "lost": ("missing", [], 1), "back": ("restored", [], 1), "both": ("updated", ["p", "missing_since"], 2)}
    replay = diff.apply_changes(old, diff.diff_state(old, new, "id", ["p", "missing_since"]), "id")
    assert sorted(map(tuple, replay.collect())) == sorted(map(tuple, new.collect()))


def test_bronze_validation(spark):
    rows = [trade(), trade(extra="1"), trade(dealAmount="abc"), trade(sggCd="99999")]
    raw = spark.createDataFrame([("11110", "202407", r) for r in rows], "p_sgg string, p_ym string, row map<string,string>")
    typed = typing.typed_trades(raw.withColumn("raw", F.col("row")))
    typed = typed.select(F.col("p_sgg").alias("sgg_cd"), F.col("p_ym").alias("deal_ym"), F.col("sgg_cd").alias("own_sgg"), F.date_format("deal_date", "yyyyMM").alias("own_ym"), F.col("raw").alias("row"), "missing", "errors")
    got = {r["check"]: r["failed"] for r in checks.validate_bronze(typed, spark.createDataFrame([("11110", 30)], "sgg_cd string, n int"), typing.TRADE_V1, typing.TRADE_REQUIRED).collect()}
    assert got == {"unknown_fields": 1, "missing_fields": 0, "unreadable": 1, "wrong_partition": 1, "row_drop": 1, "row_change_warning": 1}
    # A district whose new load is empty, one that grew from a few rows, one without an earlier load.
    previous = spark.createDataFrame([("gone", 100), ("11110", 3), ("fresh", None)], "sgg_cd string, n int")
    got = {(r["sgg_cd"], r["check"]): r["failed"] for r in checks.validate_bronze(typed, previous, typing.TRADE_V1, typing.TRADE_REQUIRED).collect()}
    assert got["gone", "row_drop"] == got["gone", "row_change_warning"] == 1 and got["11110", "row_change_warning"] == 1 and got["11110", "row_drop"] == got["fresh", "row_drop"] == got["fresh", "row_change_warning"] == 0


def test_checks_find_a_row_that_a_merge_lost(spark):
    cols = "trade_key string, dup_seq int, sgg_cd string, is_current boolean, missing_since date, missing_seq int, is_cancelled boolean"
    day = dt.date(2024, 1, 1)
    history = spark.createDataFrame([("x", 0, "a", True, None, None, False), ("m", 0, "a", True, day, 2, True), ("z", 0, "b", True, None, None, False)], cols)
    stage = spark.createDataFrame([("x", 0, "a"), ("y", 0, "a"), ("y", 1, "a")], "trade_key string, dup_seq int, sgg_cd string")
    parts = spark.createDataFrame([("a", 4), ("b", 1)], "sgg_cd string, fetch_seq int")
    got = {r["check"]: (r["failed"], r["metric"]) for r in checks.post_merge(history, stage, parts, "trade_key", 0.2).collect()}
    # a lost two rows; b has a row that no stage holds; m was missed in observations 2, 3 and 4
    assert got["stage_as_observed"] == (2, 2.0) and got["missing_3_times"][0] == 1 and got["dup_current"][0] == 0 and got["duplicate_groups"] == (0, 1.0) and got["cancel_shift"] == (1, 0.1333)


def test_reconciliation_finds_differences(spark):
    d = spark.createDataFrame([("11001", "202401", 3), ("11002", "202401", 4), ("12001", "202401", 5)], "sgg_cd string, deal_ym string, n int")
    r = spark.createDataFrame([("11", "202401", 7), ("12", "202401", 6), ("00", "202401", 12)], "region_id string, deal_ym string, n int")
    assert [tuple(x) for x in checks.reconcile_rollup(d, r, ["n"]).collect()] == [("12", "202401", "n", 5, 6)]


def test_region_derivation_aliases_and_short_names(spark):
    rows = [("1100000000", "11", "000", "000", "00", "서울특별시"), ("1111000000", "11", "110", "000", "00", "서울특별시 종로구"), ("4100000000", "41", "000", "000", "00", "경기도"), ("4111000000", "41", "110", "000", "00", "경기도 수원시"), ("4111100000", "41", "111", "000", "00", "경기도 수원시 장안구"), ("3611000000", "36", "110", "000", "00", "세종특별자치시"), ("1111010100", "11", "110", "101", "00", "서울특별시 종로구 새들읍"), ("1111010200", "11", "110", "102", "00", "서울특별시 종로구 새들읍 샘골리")]
    df = spark.createDataFrame(rows, "region_cd string, sido_cd string, sgg_cd string, umd_cd string, ri_cd string, locatadd_nm string")
    got = {r["sgg_cd"]: (r["sgg_nm"], r["is_leaf"]) for r in regions.derive_regions(df).collect()}
    assert got == {"11110": ("종로구", True), "41110": ("수원시", False), "41111": ("수원시 장안구", True), "36110": ("세종특별자치시", True)}
    seen = spark.createDataFrame([("11110", "새들면"), ("11110", "새들면 샘골리"), ("11110", "새들읍"), ("11110", "다른면")], "sgg_cd string, umd_nm string")
    assert sorted(map(tuple, regions.derive_aliases(regions.official_names(df), seen).collect())) == [("11110", "새들읍", "새들면"), ("11110", "새들읍 샘골리", "새들면 샘골리")]
    sido = spark.createDataFrame([("11", "서울특별시"), ("43", "충청북도"), ("44", "충청남도")], "sido_cd string, sido_nm string")
    short = spark.createDataFrame([("서울",), ("충북",), ("충청",), ("전국",), ("x",)], "short string")
    assert {r[0]: r[1] for r in regions.match_short_names(short, sido).collect()} == {"서울": "11", "충북": "43", "충청": None, "전국": "00", "x": None}


def test_control_rules():
    today = dt.date(2026, 9, 15)
    assert [control.priority(m, today) for m in ("202609", "202607", "202606", "202510", "202509")] == ["incremental", "incremental", "recheck", "recheck", "backfill"]
    limits = control.ceilings(1000, 100, True)
    assert limits == {"incremental": 1000, "recheck": 700, "backfill": 0}
    due = [("202609", "a", "PENDING"), ("202609", "b", "PENDING"), ("202601", "a", "RETRY"), ("202602", "a", "MERGED"), ("202001", "a", "PENDING")]
    runs = control.plan(due, today, 0, limits, {"202602"}, ["202601", "202605"])
    assert [(r.ym, r.kind) for r in runs] == [("202601", "retry"), ("202609", "incremental"), ("202605", "publish-only")] or [(r.ym, r.kind) for r in runs] == [("202609", "incremental"), ("202601", "retry"), ("202605", "publish-only")]
    assert control.within_plan(13, 10, 5, {"range_months": 12, "page_size": 100}) == ["range_months"] and quality.backfill_days(10, 3) == 4


def test_state_transitions(spark):
    cols = "source string, sgg_cd string, deal_ym string, status string, attempts int, rows_prev long, rows_last long, payload_sha256 string, last_ingest_id string, merged_ingest_id string, schema_ver int, last_fetched_at timestamp, last_changed_at timestamp, next_due_at timestamp, fetch_count int, last_error string"
    at = dt.datetime(2026, 9, 15)
    state = lambda s, ing="i1", tries=0, source="trade": (source, s, "202609", "FETCHING", tries, None, 5, "h", ing, "i1", None, at, at, at, 4, "old")
    seen = [("a", "loaded"), ("b", "unchanged"), ("c", "unchanged"), ("d", "failed"), ("e", "failed"), ("f", "interrupted"), ("h", "rejected"), ("i", "released")]
    observed = spark.createDataFrame([("trade", s, "202609", k, at, "e" * 600, 7, "h2", "i2", 2) for s, k in seen], "source string, sgg_cd string, deal_ym string, kind string, at timestamp, error string, rows long, sha string, ingest_id string, schema_ver int")
    states = spark.createDataFrame([state("a"), state("b"), state("c", "i9"), state("d", tries=1), state("e", tries=2), state("f"), state("g"), state("h"), state("i", tries=2), state("a", source="rent")], cols)
    got = {(r["source"], r["sgg_cd"]): r for r in quality.transitions(states, observed).collect()}
    assert {k: got["trade", k]["status"] for k in "abcdefghi"} == {"a": "LOADED", "b": "MERGED", "c": "LOADED", "d": "RETRY", "e": "QUARANTINED", "f": "RETRY", "g": "FETCHING", "h": "QUARANTINED", "i": "RETRY"}
    a, e = got["trade", "a"], got["trade", "e"]
    assert a["rows_prev"] == 5 and a["rows_last"] == 7 and a["next_due_at"] == at + dt.timedelta(days=1) and a["fetch_count"] == 5 and a["last_error"] is None and a["schema_ver"] == 2
    assert e["attempts"] == 3 and e["next_due_at"] == at + dt.timedelta(minutes=90) and len(e["last_error"]) == 500 and e["fetch_count"] == 4
    assert got["trade", "i"]["attempts"] == 2 and got["trade", "f"]["next_due_at"] == at + dt.timedelta(hours=1) and got["rent", "a"]["status"] == "FETCHING"


def test_redaction_leaves_no_credential(spark):
    for text, want in {
        '{"password": "hunter2", "n": 1}': '{"password": "***", "n": 1}', "pwd=abc;x=1": "pwd=***", "'access_key' : 'AK'": "'access_key' : '***'", "private-key: zz, ok": "private-key: ***, ok", "x-api-key: k9": "x-api-key: ***",
        'Authorization: "Basic dXNlcg=="': 'Authorization: "***"', "redis://:pw@h": "redis://:***@h", "https://h/?X-Amz-Signature=ab&b=2": "https://h/?X-Amz-Signature=***&b=2", "key=v1": "key=***", "monkey=v1": "monkey=v1",
        "aws_secret_access_key=z z": "aws_secret_access_key=*** z", "zz_live_ABCDEFGHJKLM.abcdefghijklmnopqrstu": "zz_live_***", None: "",
    }.items():
        assert one(spark, quality.redact, text) == want, text


def test_redaction_and_search(spark):
    assert one(spark, quality.redact, "GET http://u:pw@h/?serviceKey=abc&x=1 Authorization: Bearer zzz") == "GET http://u:***@h/?serviceKey=***&x=1 Authorization: ***"
    df = spark.createDataFrame([("1", "강남구", "서울 강남구"), ("2", "수원시 강남동", "경기 수원시 강남동"), ("3", "남구", "부산 남구")], "sgg_cd string, sgg_nm string, full_nm string")
    assert [r["sgg_cd"] for r in quality.region_search(df, "강남").collect()] == ["1", "2"]
    assert [r["sgg_cd"] for r in quality.region_search(df, "ㄴㄱ").collect()] == ["1", "3"] or [r["sgg_cd"] for r in quality.region_search(df, "ㄴㄱ").collect()] == ["3"]


def test_window_completeness(spark):
    states = spark.createDataFrame([("a", "trade", "202401", dt.datetime(2024, 2, 1), None), ("b", "trade", "202401", dt.datetime(2024, 4, 1), 5), ("c", "trade", "202401", dt.datetime(2024, 4, 1), None), ("d", "trade", "202401", None, 5)], "sgg_cd string, source string, deal_ym string, last_changed_at timestamp, rows_prev int")
    got = serving.done_partitions(states.withColumn("published_at", F.lit(dt.datetime(2024, 3, 1))))
    assert {r["sgg_cd"] for r in got.collect()} == {"a", "b"}
    cells = spark.createDataFrame([("a", s, f"2024{m:02d}") for s in ("trade", "rent") for m in range(1, 13) if (s, m) != ("rent", 4)], "sgg_cd string, source string, deal_ym string")
    assert [tuple(r) for r in serving.complete_windows(cells, 2, 3).orderBy("no").collect()] == [("a", 2024 * 12 + 3)] + [("a", 2024 * 12 + m) for m in range(7, 13)]


def test_python_functions_run_where_the_package_is_not_installed(tmp_path):
    """The session starts in another folder and the path is set in the driver alone, as on executors without the package."""
    import os
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent("""
        import sys
        sys.path.insert(0, sys.argv[1])
        from pyspark.sql import SparkSession
        from deedflow.functions import keys
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        rows = spark.createDataFrame([("\\uff21 b",), (None,)], "x string").repartition(1)
        print([r[0] for r in rows.select(keys.norm_text(rows.x)).collect()])
    """)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.strip() in ("['ab', '']", "['', 'ab']"), done.stderr[-2000:]
