"""The corpus pipeline, stage by stage, on planted cases."""

import random

import corpus_pipeline as P


def test_stages_act_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["ba", "re", "on", "ti", "la", "ku", "mi", "so"], k=rng.randrange(2, 5)))
    text = lambda n=120: "\n".join(" ".join(word() for _ in range(20)) for _ in range(n // 20))
    rows = [[k, text(), "en", f"s{k % 3}"] for k in range(300)]
    junk = set(range(0, 300, 6))
    for k in junk:
        rows[k][1] = " ".join(word().upper() + "!!" for _ in range(60))
    for k in range(1, 300, 2):
        rows[k][1] = "SHARED banner line of the site\n" + rows[k][1]
    copy, near, leak = 1000, 1001, 1002
    w = rows[7][1].split(" ")
    w[30] = "changed"
    bench = text(40)
    rows += [[copy, rows[7][1], "en", "s0"], [near, " ".join(w), "en", "s1"], [leak, text() + " " + bench + " " + text(), "en", "s2"]]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k not in junk), 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, set(range(300)) | {copy, near, leak}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        assert docs.count() == docs.select("doc_id").distinct().count()
        if name != "mixture":
            assert docs.columns == columns
        if name == "quality":
            ids -= junk
        if name == "lines":
            assert docs.where("text like '%banner%'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            ids -= {copy, near}
        if name == "benchmarks":
            ids -= {leak}
        assert {r[0] for r in docs.select("doc_id").collect()} == ids, name
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]
    run = P.run(spark, d)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def planted(spark, d, rows, labels, bench, extra=()):
    """Tables of one folder; documents have columns whose names clash with the stages' own."""
    names = ["gone", "row", "host", "dropped", "kept", "id", "t", "i", "found", "node", *extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *["clash"] * len(names)) for r in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Each stage by itself: null and empty texts, null ids, rows that repeat an id with equal or other texts."""
    d = str(tmp_path)
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(1, passage), (1, passage), (2, passage + " end"), (3, None), (4, ""), (None, passage), (5, "unlike words of quite another kind here"), (5, "and yet another text under the same id"), (6, "x " * 3000)]
    docs = planted(spark, d, rows, [(1, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], [(1, "unlike words of quite another kind here"), (2, None), (3, "")])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
        if name == "lines":
            assert got == [-1, 1, 1, 2, 3, 4, 5, 5, 6]
        if name == "near_duplicates":  # 2 is near 1; 4 is as empty as 3; rows of one id stay together, null ids stay
            assert got == [-1, 1, 1, 3, 5, 5, 6]
        if name == "benchmarks":  # an id with a hit goes with all its rows
            assert got == [-1, 1, 1, 2, 3, 4, 6]
    assert P.mixture(spark, docs, d).count() == len(rows)
    assert {r["taken"] for r in P.mixture(spark, docs, d).where("size = 0").collect()} == {0}


def test_stages_on_an_empty_table(spark, tmp_path):
    d = str(tmp_path)
    docs = planted(spark, d, [], [], [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    assert P.run(spark, d).count() == 0


def test_near_duplicates_of_textual_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([("b", text, "g"), ("a", text + " more", "g"), ("c", "other", "g")], "doc_id string, text string, gone string")
    assert sorted(r[0] for r in P.near_duplicates(spark, docs, "").collect()) == ["a", "c"]
