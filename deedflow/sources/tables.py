"""Tables on plain Parquet: versioned writes with a pointer, exactly-once appends, snapshots, exports."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or one of our own where a local master has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="deedflow-shared-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df computed once, into the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Written beside and renamed, so readers see the old or the new file, never a part. Without replace an existing file
    stays, and the answer is whether this one is now there."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(tmp, p, options)
    except Py4JJavaError as e:
        if replace or "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        fs.delete(tmp, False)
        return False
    return True


class Table:
    """A table of month partitions. A month is written to a directory of its own and becomes current when the pointer
    file names it; several months and tables can be committed by one pointer, all or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self, no: int) -> dict | None:
        text = _read_text(self.spark, f"{self.root}/_versions/{no}.json")
        return json.loads(text) if text else None

    def pointer(self) -> dict:
        """The state in force: what the pointer file names, or a later version whose committer has not moved it yet."""
        now = json.loads(_read_text(self.spark, f"{self.root}/_current.json") or '{"version": 0, "paths": {}}')
        while (after := self._version(now["version"] + 1)) is not None:
            now = after
        return now

    def stage(self, name: str, month: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/deal_ym={month}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def stage_months(self, name: str, df: DataFrame, sort: list[str]) -> str:
        """All months of a table in one job, one directory a month, sorted inside; committed under the month "*"."""
        path = f"{self.root}/{name}/deal_ym=all/{uuid.uuid4().hex}"
        df.repartition("deal_ym").sortWithinPartitions("deal_ym", *sort).write.partitionBy("deal_ym").parquet(path)
        _write_text(self.spark, f"{path}/_schema.json", df.schema.json())
        return path

    def stage_whole(self, name: str, df: DataFrame, sort: list[str]) -> str:
        """A table of few rows, such as one row a district and month, as one sorted file; committed under the month "*"."""
        path = f"{self.root}/{name}/deal_ym=all/{uuid.uuid4().hex}"
        df.repartition(1).sortWithinPartitions(*sort).write.parquet(path)
        _write_text(self.spark, f"{path}/_schema.json", df.schema.json())
        return path

    def read_months(self, name: str) -> DataFrame:
        """A table that was staged with all its months: filters on deal_ym choose directories, or row groups, to read."""
        return self.read_path(self.pointer()["paths"][f"{name}/*"])

    def read_path(self, path: str) -> DataFrame:
        """What stage_months or stage_whole has written to a path."""
        schema = T.StructType.fromJson(json.loads(_read_text(self.spark, f"{path}/_schema.json")))
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def commit(self, staged: dict[tuple[str, str], str], lineage: dict | None = None) -> int:
        """Makes the staged paths current, as one new version. A version file is written by one committer alone; one that
        comes second takes the other's state and tries the next number, so no update is lost. lineage (run, sources, row
        counts, as-of times) is kept with the version."""
        while True:
            now = self.pointer()
            now = {"version": now["version"] + 1, "paths": now["paths"] | {f"{name}/{month}": path for (name, month), path in staged.items()}, "lineage": lineage or {}}
            if _write_text(self.spark, f"{self.root}/_versions/{now['version']}.json", json.dumps(now), replace=False):
                break
        _write_text(self.spark, f"{self.root}/_current.json", json.dumps(now))
        return now["version"]

    def lineage(self, version: int | None = None) -> dict:
        """What was recorded with a version, the current one if none is named (V6)."""
        state = self.pointer() if version is None else self._version(version)
        return (state or {}).get("lineage", {})

    def orphans(self, name: str) -> list[str]:
        """Staged directories of a table that no version names: left by writers that failed before their commit."""
        fs, p = _fs(self.spark, f"{self.root}/{name}/*/*")
        found = fs.globStatus(p) or []
        known = {path.split("/")[-1] for v in range(1, self.pointer()["version"] + 1) for path in (self._version(v) or {"paths": {}})["paths"].values()}
        return sorted(f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName() not in known)

    def read(self, name: str, months: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        state = self.pointer() if version is None else json.loads(_read_text(self.spark, f"{self.root}/_versions/{version}.json") or '{"paths": {}}')
        paths = [p for k, p in state["paths"].items() if k.split("/")[0] == name and (months is None or k.split("/")[1] in months)]
        return self.spark.read.parquet(*paths) if paths else None

    def unused(self, keep: int) -> list[str]:
        """Paths that only versions older than the last `keep` name: what maintenance may delete."""
        last = self.pointer()["version"]
        held = [json.loads(_read_text(self.spark, f"{self.root}/_versions/{v}.json") or '{"paths": {}}')["paths"].values() for v in range(1, last + 1)]
        live = {p for paths in held[max(0, last - keep) :] for p in paths}
        return sorted({p for paths in held for p in paths} - live)


def reconciled(staged: DataFrame, source: DataFrame, sums: list[str]) -> bool:
    """Whether a written table holds what it was written from: equal row count and equal exact sums."""
    one = [F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(38,4)")) for c in sums)]
    return staged.agg(*one).first() == source.agg(*one).first()


def publish(table: Table, month: str, frames: dict[str, DataFrame], sums: dict[str, list[str]]) -> int:
    """All tables of a month become current at once, after each was read back and reconciled; on a difference none does."""
    staged = {(name, month): table.stage(name, month, df) for name, df in frames.items()}
    for (name, _), path in staged.items():
        if not reconciled(table.spark.read.parquet(path), frames[name], sums.get(name, [])):
            raise ValueError(f"{name} {month}: the written rows differ from their source")
    return table.commit(staged)


def version_name(day: str, before: list[str], prefix: str = "gold") -> str:
    """The next version name of a local day."""
    return f"{prefix}@{day}.{sum(v.startswith(f'{prefix}@{day}.') for v in before) + 1}"


def append_new(new: DataFrame, held: DataFrame | None, key: str = "payload_sha256") -> DataFrame:
    """Rows of payloads that are not held yet; a payload that comes twice in new is taken once by its rows' order."""
    once = new.dropDuplicates([key, "row_ord"]) if "row_ord" in new.columns else new.dropDuplicates([key])
    return once if held is None else once.join(held.select(key).distinct(), key, "left_anti")


def overwrite_months(df: DataFrame, path: str) -> None:
    """Replaces the months that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("deal_ym").parquet(path)


def overwrite_unless_empty(df: DataFrame, path: str) -> bool:
    """A source that suddenly gives nothing leaves the rows that are there."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_snapshot(df: DataFrame, schema: dict[str, str], path: str) -> DataFrame:
    """A month's rows with a fixed schema, compressed with zstd; gives (file, sha256). An empty month still has its schema."""
    df.select(*(F.col(c).cast(t).alias(c) for c, t in schema.items())).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def export(spark: SparkSession, files: list[tuple[str, str]], where: Column, columns: list[str]) -> DataFrame:
    """Filtered and projected rows of snapshot files, after their hashes were checked."""
    found = spark.read.format("binaryFile").load([f for f, _ in files]).select("path", F.sha2("content", 256).alias("h"))
    if {r["h"] for r in found.collect()} != {h for _, h in files}:
        raise ValueError("a snapshot file differs from its recorded hash")
    return spark.read.parquet(*(f for f, _ in files)).where(where).select(*columns)


def retained(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows of the last `days`."""
    return df.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def archive_missing(payloads: DataFrame, archived: DataFrame) -> DataFrame:
    """Payloads whose content is not in the archive yet, under their content address."""
    named = payloads.withColumn("sha256", F.sha2(F.encode("payload", "UTF-8"), 256)).dropDuplicates(["sha256"])
    path = F.format_string("deal_ym=%s/sgg_cd=%s/%s", "deal_ym", "sgg_cd", "sha256")
    return named.join(archived.select("sha256"), "sha256", "left_anti").withColumn("path", path)


def archive_put(payloads: DataFrame, root: str) -> None:
    """Adds the payloads (deal_ym, sgg_cd, payload) that the archive does not hold (S5); what it holds is never rewritten."""
    spark = payloads.sparkSession
    fs, p = _fs(spark, root)
    held = spark.read.parquet(root) if fs.exists(p) else payloads.limit(0).withColumn("sha256", F.lit(""))
    archive_missing(payloads, held).drop("path").write.mode("append").partitionBy("deal_ym").parquet(root)


def archive_get(spark: SparkSession, root: str, sha256: str, month: str) -> str | None:
    """A payload by its content address, from its month alone; one that does not hash to its address is refused."""
    rows = spark.read.parquet(root).where((F.col("deal_ym") == month) & (F.col("sha256") == sha256)).select("payload", F.sha2(F.encode("payload", "UTF-8"), 256).alias("h")).take(1)
    if rows and rows[0]["h"] != sha256:
        raise ValueError(f"{sha256}: the archived payload differs")
    return rows[0]["payload"] if rows else None


def compact(table: Table, name: str, month: str, rows: int, sort: list[str]) -> int:
    """Rewrites a month in files of about `rows` rows, sorted inside so that page statistics prune, as a new version: the
    files that are read stay until no version names them (V13)."""
    path = f"{table.root}/{name}/deal_ym={month}/{uuid.uuid4().hex}"
    table.read(name, [month]).sortWithinPartitions(*sort).write.option("maxRecordsPerFile", rows).parquet(path)
    return table.commit({(name, month): path}, {"compacted": name})
