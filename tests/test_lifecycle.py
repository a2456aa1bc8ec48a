"""History life cycle, publishing, sources, snapshots, streams and the index against a dense fit."""

import datetime as dt
import hashlib
import io
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedflow.operators.scd2 import greatest_by_key, merge_complexes, merge_history, merge_regions, serial_conflicts
from deedflow.plans import hedonic
from deedflow.sources import pages, tables
from deedflow.streaming import ingest

HISTORY = "trade_key string, dup_seq int, sgg_cd string, attr_hash string, price int, seq string, version int, valid_from timestamp, valid_to timestamp, is_current boolean, ingest_id string, last_seen_ingest string, last_seen_at timestamp, missing_since timestamp, missing_seq int"
STAGE = "trade_key string, dup_seq int, sgg_cd string, attr_hash string, price int, seq string"


def observe(spark, history, n, rows, districts=("a",)):
    stage = spark.createDataFrame([(k, 0, s, f"h{p}", p, q) for k, s, p, q in rows], STAGE)
    parts = spark.createDataFrame([(d, f"i{n}", dt.datetime(2024, 1, n), n) for d in districts], "sgg_cd string, ingest_id string, seen_at timestamp, fetch_seq int")
    merged = merge_history(history, stage, parts, "trade_key", ["price", "seq"], ["seq"])
    return spark.createDataFrame(merged.collect(), HISTORY)


def state(df):
    return sorted((r["trade_key"], r["version"], r["price"], r["seq"], r["is_current"], r["missing_seq"], r["last_seen_ingest"]) for r in df.collect())


def test_history_life_cycle(spark):
    h = spark.createDataFrame([], HISTORY)
    first = [("x", "a", 1, "s"), ("y", "a", 2, None), ("z", "b", 3, None)]
    h = observe(spark, h, 1, first, ("a", "b"))
    for _ in range(2):  # the same observation again changes nothing
        assert state(h) == state(observe(spark, h, 1, first, ("a", "b")))
    h = observe(spark, h, 2, [("x", "a", 9, None), ("w", "a", 4, None)])  # x changes, y is gone, w is new; b is not observed
    assert state(h) == [("w", 1, 4, None, True, None, "i2"), ("x", 1, 1, "s", False, None, "i1"), ("x", 2, 9, "s", True, None, "i2"), ("y", 1, 2, None, True, 2, "i1"), ("z", 1, 3, None, True, None, "i1")]
    h = observe(spark, h, 3, [("x", "a", 9, "t"), ("w", "a", 4, None)])  # y stays missing since the second; enrichment is filled
    rows = {(r["trade_key"], r["version"]): r for r in h.collect()}
    assert rows["y", 1]["missing_seq"] == 2 and rows["x", 2]["seq"] == "t" and rows["x", 1]["valid_to"] == rows["x", 2]["valid_from"]
    h = observe(spark, h, 4, [("x", "a", 9, None), ("w", "a", 4, None), ("y", "a", 2, None)])  # y is back, without a new version
    rows = {(r["trade_key"], r["version"]): r for r in h.collect()}
    assert rows["y", 1]["missing_since"] is None and rows["y", 1]["is_current"] and rows["x", 2]["seq"] == "t" and len(rows) == 5


def test_complexes_only_improve(spark):
    cols = "complex_key string, sgg_cd string, umd_nm string, jibun string, apt_nm string, build_year int, land_leasehold boolean, first_seen date, apt_seq string"
    stage_cols = cols.replace("first_seen", "deal_date")
    d = dt.date
    dim = spark.createDataFrame([("c1", "a", "u", "1", "n", None, None, d(2024, 5, 1), None), ("c2", "a", "u", "2", "n", 2000, True, d(2024, 5, 1), "s2")], cols)
    stage = spark.createDataFrame([("c1", "a", "u", "1", "n", 1999, False, d(2024, 1, 1), "s1"), ("c2", "a", "u", "2", "n", 1990, False, d(2024, 9, 1), "s9"), ("c3", "b", "v", "3", "m", 2010, None, d(2024, 2, 1), "x"), ("c3", "b", "v", "3", "m", 2011, None, d(2024, 3, 1), "y")], stage_cols)
    got = {r["complex_key"]: r for r in merge_complexes(dim, stage).collect()}
    assert (got["c1"]["build_year"], got["c1"]["first_seen"], got["c1"]["apt_seq"], got["c1"]["land_leasehold"]) == (1999, d(2024, 1, 1), "s1", False)
    assert (got["c2"]["build_year"], got["c2"]["first_seen"], got["c2"]["apt_seq"], got["c2"]["land_leasehold"]) == (2000, d(2024, 5, 1), "s2", True)
    assert got["c3"]["apt_seq"] is None and got["c3"]["land_leasehold"] is None and got["c3"]["build_year"] == 2011
    lease = {r["complex_key"]: r for r in merge_complexes(dim, stage, spark.createDataFrame([("c1",)], "complex_key string")).collect()}
    assert lease["c1"]["build_year"] is None and lease["c1"]["first_seen"] == d(2024, 1, 1) and lease["c3"]["build_year"] == 2011
    assert tuple(serial_conflicts(stage, dim).first()) == (1, 0, 1)


def test_region_merge_and_map_maximum(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "region_cd string, nm string")
    new = spark.createDataFrame([("2", "B"), ("3", "c")], "region_cd string, nm string")
    assert sorted(map(tuple, merge_regions(old, new).collect())) == [("1", "a", False), ("2", "B", True), ("3", "c", True)]
    m = spark.range(1).select(greatest_by_key(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(5)), F.create_map(F.lit("b"), F.lit(2), F.lit("c"), F.lit(3)))).first()[0]
    assert m == {"a": 1, "b": 5, "c": 3}


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    t = tables.Table(spark, str(tmp_path / "t"))
    a = spark.range(5).withColumn("v", F.col("id") * 1.5)
    assert tables.publish(t, "202401", {"x": a, "y": a}, {"x": ["v"]}) == 1
    assert tables.publish(t, "202402", {"x": a.limit(2), "y": a}, {}) == 2
    assert t.read("x").count() == 7 and t.read("x", ["202402"]).count() == 2 and t.read("x", version=1).count() == 5 and t.read("zz") is None
    assert tables.publish(t, "202401", {"x": a.limit(1)}, {}) == 3 and t.read("x").count() == 3 and t.read("x", version=2).count() == 7
    assert len(t.unused(1)) == 1 and t.unused(3) == []
    assert not tables.reconciled(a, a.limit(4), ["v"]) and not tables.reconciled(a, a.withColumn("v", F.col("v") + 1), ["v"])
    monkeypatch.setattr(tables, "reconciled", lambda *_: False)
    with pytest.raises(ValueError, match="differ"):
        tables.publish(t, "202401", {"x": a}, {"x": ["v"]})
    assert t.pointer()["version"] == 3
    assert tables.version_name("2026-01-02", ["gold@2026-01-02.1", "gold@2026-01-01.1"]) == "gold@2026-01-02.2"


def test_appends_exactly_once(spark):
    new = spark.createDataFrame([("h1", 0), ("h1", 1), ("h2", 0), ("h2", 0)], "payload_sha256 string, row_ord int")
    held = spark.createDataFrame([("h1", 0)], "payload_sha256 string, row_ord int")
    assert tables.append_new(new, held).count() == 1 and tables.append_new(new, None).count() == 3


def test_snapshot_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, s string, v double")
    schema = {"id": "bigint", "s": "string", "v": "decimal(9,4)"}
    files = [tuple(r) for r in tables.write_snapshot(df, schema, str(tmp_path / "m")).collect()]
    empty = tables.write_snapshot(df.where("false"), schema, str(tmp_path / "e")).collect()
    assert len(empty) == 1 and spark.read.parquet(empty[0]["file"]).columns == list(schema)
    assert [tuple(r) for r in tables.export(spark, files, F.col("id") > 1, ["s"]).collect()] == [("b",)]
    with pytest.raises(ValueError, match="hash"):
        tables.export(spark, [(files[0][0], "0" * 64)], F.lit(True), ["s"])
    assert not tables.overwrite_unless_empty(df.where("false"), str(tmp_path / "m"))


PAGE = "<response><header><resultCode>000</resultCode></header><body><items>{items}</items><totalCount>{total}</totalCount><pageNo>{no}</pageNo></body></response>"
ITEM = "<item><sggCd>11110</sggCd><floor> </floor><aptNm>{n}</aptNm></item>"


def test_pages_and_bronze_rows(spark):
    ok = PAGE.format(items=ITEM.format(n="x") + "<item><aptNm>y</aptNm></item>", total=2, no=1)
    gate = "<OpenAPI_ServiceResponse><cmmMsgHeader><returnReasonCode>22</returnReasonCode></cmmMsgHeader></OpenAPI_ServiceResponse>"
    bad = ok.replace("000", "99")
    df = spark.createDataFrame([(1, ok), (2, gate), (3, bad)], "k int, xml string")
    got = {r["k"]: r for r in pages.parse_pages(df, ["sggCd", "floor", "aptNm"]).collect()}
    assert got[1]["error"] is None and got[1]["items"] == [{"sggCd": "11110", "floor": " ", "aptNm": "x"}, {"aptNm": "y"}] and got[1]["total_count"] == 2 and got[1]["parsed"]
    assert got[2]["error"] == "22" and got[3]["error"] == "99"
    rows = pages.bronze_rows(pages.parse_pages(df.where("k = 1"), ["sggCd", "floor", "aptNm"])).orderBy("row_ord").collect()
    assert [r["row_json"] for r in rows] == ['{"aptNm":"x","floor":" ","sggCd":"11110"}', '{"aptNm":"y"}']


def test_paged_source_reads_all_pages(spark, tmp_path):
    for month, sizes in (("202401", [2, 1]), ("202402", [1])):
        for no, n in enumerate(sizes, 1):
            (tmp_path / f"11110-{month}-{no}.xml").write_text(PAGE.format(items=ITEM.format(n="x") * n, total=sum(sizes), no=no))
    spark.dataSource.register(pages.PagedSource)
    df = spark.read.format("paged_xml").options(url=f"file://{tmp_path}/{{district}}-{{month}}-{{page}}.xml", districts="11110", months="202401,202402", rate="1000").load()
    assert sorted((r["deal_ym"], r["page_no"]) for r in df.collect()) == [("202401", 1), ("202401", 2), ("202402", 1)]


def test_fetch_retries_and_checks_completeness():
    slept, tries = [], []

    def get(no):
        tries.append(no)
        if len(tries) == 1:
            raise OSError
        return PAGE.format(items="" if no > 1 else ITEM.format(n="x"), total=2, no=no)

    bucket = pages.TokenBucket(100, clock=lambda: 0.0, sleep=slept.append)
    with pytest.raises(pages.LoadFailed, match="incomplete"):
        pages.fetch_all(get, bucket, jitter=lambda: 0.0)
    assert slept == [1.0] and tries == [1, 1, 2]


GATE = "<OpenAPI_ServiceResponse><cmmMsgHeader><returnReasonCode>{}</returnReasonCode></cmmMsgHeader></OpenAPI_ServiceResponse>"


def http_error(status, body=""):
    return urllib.error.HTTPError("http://x", status, "no", {}, io.BytesIO(body.encode()))


@pytest.mark.parametrize(("answer", "kind", "calls"), [
    (GATE.format("22"), pages.SourceClosed, 1), (GATE.format("30"), pages.SourceClosed, 1), (GATE.format("10"), pages.LoadFailed, 1), (GATE.format("04"), pages.LoadFailed, 3), (GATE.format(""), pages.LoadFailed, 1), ("<x", pages.LoadFailed, 1),
    (PAGE.replace("000", "99").format(items="", total=0, no=1), pages.LoadFailed, 1), (http_error(503), pages.LoadFailed, 3), (http_error(429), pages.SourceClosed, 1), (http_error(403), pages.SourceClosed, 1), (http_error(400, GATE.format("11")), pages.LoadFailed, 1),
    (http_error(400, GATE.format("22")), pages.SourceClosed, 1), (OSError(), pages.LoadFailed, 3),
])
def test_fetch_errors_by_class(answer, kind, calls):
    tries = []

    def get(no):
        tries.append(no)
        if isinstance(answer, Exception):
            raise answer
        return answer

    bucket = pages.TokenBucket(100, clock=lambda: 0.0, sleep=lambda _: None)
    with pytest.raises(kind):
        pages.fetch_all(get, bucket)
    assert len(tries) == calls


def test_paged_source_gives_errors_as_rows_and_stops_when_closed(spark, tmp_path):
    ok = PAGE.format(items=ITEM.format(n="x"), total=1, no=1)
    for month, text in (("202401", ok), ("202402", GATE.format("10")), ("202403", GATE.format("22")), ("202404", ok)):
        (tmp_path / f"a-{month}-1.xml").write_text(text)
    spark.dataSource.register(pages.PagedSource)
    df = spark.read.format("paged_xml").options(url=f"file://{tmp_path}/{{district}}-{{month}}-{{page}}.xml", districts="a", months="202401,202402,202403,202404", rate="1000", lanes="1").load()
    assert sorted((r["deal_ym"], r["page_no"], r["fetch_error"]) for r in df.collect()) == [("202401", 1, None), ("202402", 0, "10"), ("202403", 0, "quota: 22"), ("202404", 0, "skipped: quota: 22")]


def test_lanes_share_the_rate():
    r = pages.PagedReader({"months": "1,2,3", "districts": "a,b", "url": "", "rate": "8", "lanes": "4"})
    assert len(r.partitions()) == 4 and sum(len(p.loads) for p in r.partitions()) == 6


def test_no_commit_is_lost(spark, tmp_path, monkeypatch):
    a, b = (tables.Table(spark, str(tmp_path / "t")) for _ in range(2))
    assert a.commit({("x", "1"): "p1"}, {"run": "r1"}) == 1
    late, seen = a.pointer(), []
    # b commits between a's reading and its writing
    monkeypatch.setattr(a, "pointer", lambda: late if not seen and not seen.append(b.commit({("x", "2"): "p2"})) else tables.Table.pointer(a))
    assert a.commit({("x", "3"): "p3"}) == 3
    assert b.pointer()["paths"] == {"x/1": "p1", "x/2": "p2", "x/3": "p3"} and b.lineage(1) == {"run": "r1"}
    tables._write_text(spark, f"{tmp_path}/t/_current.json", '{"version": 1, "paths": {"x/1": "p1"}}')  # a committer ended before it moved the pointer
    assert b.pointer()["version"] == 3


def test_archive_compaction_and_orphans(spark, tmp_path):
    root = str(tmp_path / "archive")
    one = spark.createDataFrame([("202401", "a", "x"), ("202401", "b", "x"), ("202402", "a", "y")], "deal_ym string, sgg_cd string, payload string")
    tables.archive_put(one, root)
    tables.archive_put(one, root)
    assert spark.read.parquet(root).count() == 2
    sha = hashlib.sha256(b"y").hexdigest()
    assert tables.archive_get(spark, root, sha, "202402") == "y" and tables.archive_get(spark, root, sha, "202401") is None
    t = tables.Table(spark, str(tmp_path / "t"))
    tables.publish(t, "202401", {"x": spark.range(100).repartition(8)}, {})
    left = t.stage("x", "202401", spark.range(3))
    tables.compact(t, "x", "202401", 1000, ["id"])
    assert t.read("x").count() == 100 and t.lineage() == {"compacted": "x"} and [p.split("/")[-1] for p in t.orphans("x")] == [left.split("/")[-1]]
    path = str(tmp_path / "m")
    tables.overwrite_months(spark.createDataFrame([(1, "1"), (2, "2")], "v int, deal_ym string"), path)
    tables.overwrite_months(spark.createDataFrame([(9, "2")], "v int, deal_ym string"), path)
    assert sorted((r["v"], str(r["deal_ym"])) for r in spark.read.parquet(path).collect()) == [(1, "1"), (9, "2")]


def test_usage_sink_drops_what_overflows(spark, tmp_path):
    src, seen, dropped = str(tmp_path / "u"), [], []
    spark.range(50).coalesce(1).write.parquet(src)
    ingest.usage_sink(ingest.due_files(spark, src, "id long"), lambda df, n: seen.append((df.count(), df.rdd.getNumPartitions())), str(tmp_path / "cp"), most=10, queue=40, dropped=dropped.append).awaitTermination()
    assert seen == [(40, 4)] and dropped == [10]
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 3, 1),)], "at timestamp")
    assert tables.retained(rows, "at", "2024-03-02", 10).count() == 1


def test_stream_merges_late_observations(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    src = str(tmp_path / "in")
    schema = STAGE + ", deal_ym string, ingest_id string, seen_at timestamp, fetch_seq int"
    send = lambda n, rows: spark.createDataFrame([(k, 0, "a", f"h{p}", p, None, "202401", f"i{n}", dt.datetime(2024, 1, n), n) for k, p in rows], schema).write.mode("append").parquet(src)
    run = lambda: ingest.merge_stream(ingest.due_files(spark, src, schema), t, "silver", "trade_key", ["price", "seq"], spark.createDataFrame([], HISTORY), str(tmp_path / "cp")).awaitTermination()
    send(1, [("x", 1), ("y", 2)])
    run()
    send(2, [("x", 4)])
    send(3, [("x", 5)])  # two observations of a district in one batch
    run()
    run()  # nothing new
    rows = {(r["trade_key"], r["version"]): r for r in t.read("silver").collect()}
    assert set(rows) == {("x", 1), ("x", 2), ("x", 3), ("y", 1)} and rows["y", 1]["missing_seq"] == 2 and not rows["x", 1]["is_current"] and rows["x", 3]["price"] == 5


def dense_index(df):
    """The same model written out: dummies, demeaned by complex, least squares, clustered sandwich."""
    df = df[df.groupby("deal_ym").deal_ym.transform("size") >= 30]
    df = df[df.groupby("complex_key").complex_key.transform("size") > 1]
    months = sorted(df.deal_ym.unique())
    f = np.searchsorted([3, 10, 20], df.floor, side="left")
    a = np.searchsorted([40, 60, 85, 135], df.area_m2, side="right")
    x = np.column_stack([df.deal_ym == m for m in months[1:]] + [f == k for k in (1, 2, 3)] + [a == k for k in (1, 2, 3, 4)]).astype(float)
    y, g = np.log(df.ppm2.to_numpy()), df.complex_key.astype("category").cat.codes.to_numpy()
    n_g = np.bincount(g)
    mean = lambda v: np.array([np.bincount(g, c) / n_g for c in v.T]).T[g]
    xd, yd = x - mean(x), y - mean(y[:, None])[:, 0]
    good = (xd**2).sum(0) > 1e-9
    xd = xd[:, good]
    beta = np.linalg.lstsq(xd, yd, rcond=None)[0]
    e = yd - xd @ beta
    s = np.array([np.bincount(g, c) for c in (xd * e[:, None]).T]).T
    bread = np.linalg.inv(xd.T @ xd)
    n, k, m = len(y), xd.shape[1], len(n_g)
    cov = m / (m - 1) * (n - 1) / max(n - m - k, 1) * bread @ s.T @ s @ bread
    se = np.sqrt(np.diag(cov))
    ids = [c for c, ok in enumerate(good) if ok]
    return {months[c + 1]: (100 * np.exp(beta[j]), 100 * np.exp(beta[j] - hedonic.Z95 * se[j]), 100 * np.exp(beta[j] + hedonic.Z95 * se[j])) for j, c in enumerate(ids) if c < len(months) - 1}


def test_index_equals_a_dense_fit(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 1500
    df = pd.DataFrame({"region_id": "00", "complex_key": [f"c{k}" for k in rng.integers(0, 60, n)], "deal_ym": [f"2024{m:02d}" for m in rng.integers(1, 9, n)], "floor": rng.integers(1, 30, n), "area_m2": rng.choice([30.0, 40.0, 59.9, 84.9, 85.0, 140.0], n)})
    df.loc[:5, "deal_ym"] = "202412"  # too few rows
    df["ppm2"] = np.exp(6 + 0.01 * df.deal_ym.str[4:].astype(int) + rng.normal(0, 0.1, n) + df.floor * 0.002)
    df.loc[10, "ppm2"] = 0.0
    got = {r["deal_ym"]: r for r in hedonic.fit_index(spark.createDataFrame(df)).collect()}
    want = dense_index(df[df.ppm2 > 0])
    assert got["202401"]["value"] == got["202401"]["lo"] == 100 and set(got) == {"202401", *want}
    for m, (v, lo, hi) in want.items():
        assert got[m]["value"] == pytest.approx(v, rel=1e-9) and got[m]["lo"] == pytest.approx(lo, rel=1e-7) and got[m]["hi"] == pytest.approx(hi, rel=1e-7)


def test_index_validation(spark):
    ours = spark.createDataFrame([("00", f"2024{m:02d}", 100.0 + m) for m in range(1, 10)], "region_id string, deal_ym string, value double")
    ref = spark.createDataFrame([("00", f"2024{m:02d}", 100.0 + m * m) for m in range(1, 10)], "region_id string, deal_ym string, value double")
    r = hedonic.validate_index(ours, ref).first()
    assert r["n_months"] == 8 and r["direction_match"] == 1.0 and -1 <= r["corr_mom"] <= 1
    assert hedonic.validate_index(ours.where("deal_ym < '202404'"), ref).first()["corr_mom"] is None
