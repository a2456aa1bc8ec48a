"""Fixed-effects price index with cluster-robust intervals (H1-H8).

log(ppm2) is explained by month, floor band and area band, with a fixed effect for each complex. All regressors are
categories, so the normal equations are counts and sums: Spark aggregates them per region, and the small dense systems
(months + 7 columns) are solved in numpy, one region to a task. Nothing grows with the number of trades but the scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.functions.values import AREA_EDGES, FLOOR_EDGES, band, month_no
from deedflow.sources.tables import written

MIN_MONTH = 30
Z95 = 1.959963984540054
N_FLOOR, N_AREA = len(FLOOR_EDGES), len(AREA_EDGES)


def sample(trades: DataFrame, region: str = "region_id") -> DataFrame:
    """Usable rows: finite and positive, in months of 30 rows or more, then in complexes of two rows or more (H3)."""
    ok = trades.where((F.col("ppm2") > 0) & (F.col("ppm2") < float("inf")) & (F.col("area_m2") > 0) & F.col("floor").isNotNull())
    months = ok.groupBy(region, "deal_ym").count().where(F.col("count") >= MIN_MONTH).select(region, "deal_ym")
    ok = ok.join(months, [region, "deal_ym"], "left_semi")
    several = ok.groupBy(region, "complex_key").count().where("count > 1").select(region, "complex_key")
    ok = ok.join(several, [region, "complex_key"], "left_semi")
    order = F.dense_rank().over(W.partitionBy(region).orderBy("deal_ym"))
    ranks = ok.select(region, "deal_ym").distinct().withColumn("m", order - 1)
    return ok.join(F.broadcast(ranks), [region, "deal_ym"]).select(region, "complex_key", "deal_ym", "m", band(F.col("floor"), FLOOR_EDGES, True).alias("f"), band(F.col("area_m2"), AREA_EDGES, False).alias("a"), F.log("ppm2").alias("y"))


def _long(rows: DataFrame) -> DataFrame:
    """Each row's active columns: months are numbered from 0, floor bands from -100, area bands from -200; the first of
    each factor is the reference and has none."""
    cols = F.array_compact(F.array(F.when(F.col("m") > 0, F.col("m")), F.when(F.col("f") > 0, -100 - F.col("f")), F.when(F.col("a") > 0, -200 - F.col("a"))))
    return rows.withColumn("cols", cols)


def _gram(lists: DataFrame) -> DataFrame:
    """(region_id, i, j, v): sums of w x_i x_j, and of w x_i y as j = 0, over rows (region_id, xs, w, y).

    Each task adds dense products of its batches and gives one small matrix a region, so no pair of columns of a
    complex ever becomes a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[dict[int, int], np.ndarray]] = {}
        for b in batches:
            region, xs = np.array(b.column(0).to_pylist()), b.column(1)
            off, values = xs.offsets.to_numpy(), xs.values
            col, x = values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)
            w, y = b.column(2).to_numpy(), b.column(3).to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            for name in np.unique(region):
                at, held = sums.get(name, ({0: 0}, np.zeros((1, 1))))
                mine = region[row] == name
                for c in np.unique(col[off[0] :][: len(row)][mine]).tolist():
                    at.setdefault(c, len(at))
                grown = np.zeros((len(at), len(at)))
                grown[: len(held), : len(held)] = held
                rows = np.flatnonzero(region == name)
                dense = np.zeros((len(rows), len(at)))
                dense[:, 0] = y[rows]
                place = np.zeros(b.num_rows, np.int64)
                place[rows] = np.arange(len(rows))
                dense[place[row[mine]], [at[c] for c in col[off[0] :][: len(row)][mine].tolist()]] = x[off[0] :][: len(row)][mine]
                sums[name] = at, grown + dense.T @ (dense * w[rows, None])
        for name, (at, held) in sums.items():
            ids = np.array(list(at), np.int32)
            i, j = np.nonzero(held)
            keep = i > 0  # the square of y is not needed
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(keep.sum()), pa.string()), pa.array(ids[i[keep]]), pa.array(ids[j[keep]]), pa.array(held[i, j][keep])], ["region_id", "i", "j", "v"])

    parts = lists.select("region_id", "xs", F.col("w").cast("double"), F.col("y").cast("double")).mapInArrow(run, "region_id string, i int, j int, v double")
    return parts.groupBy("region_id", "i", "j").agg(F.sum("v").alias("v"))


def moments(rows: DataFrame) -> DataFrame:
    """(region_id, i, j, v): the normal equations after the within transform; j is 0 for the right-hand side."""
    cells = _long(rows.groupBy("region_id", "m", "f", "a").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y")))
    pairs = cells.withColumn("i", F.explode("cols")).withColumn("j", F.explode("cols")).select("region_id", "i", "j", F.col("n").alias("v"))
    right = cells.withColumn("i", F.explode("cols")).select("region_id", "i", F.lit(0).alias("j"), F.col("y").alias("v"))
    # Of each complex only the sums by column are needed; it has as many as it has different months and bands.
    group = rows.groupBy("region_id", "complex_key").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    parts = _long(rows).withColumn("i", F.explode("cols")).groupBy("region_id", "complex_key", "i").agg(F.count(F.lit(1)).cast("double").alias("x"))
    lists = parts.groupBy("region_id", "complex_key").agg(F.collect_list(F.struct("i", "x")).alias("xs")).join(group, ["region_id", "complex_key"])
    within = _gram(lists.select("region_id", "xs", (F.lit(-1.0) / F.col("n")).alias("w"), "y"))
    return pairs.unionByName(right).unionByName(within).groupBy("region_id", "i", "j").agg(F.sum("v").alias("v"))


def _solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids = np.sort(pdf.loc[pdf["j"] != 0, "i"].unique())
    at = {int(c): k for k, c in enumerate(ids)}
    xtx, xty = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"], strict=True):
        if j:
            xtx[at[i], at[j]] = v
        elif i in at:
            xty[at[i]] = v
    good = np.diag(xtx) > 1e-9  # columns that the sample cannot tell are dropped
    bread = np.linalg.inv(xtx[np.ix_(good, good)])
    beta = bread @ xty[good]
    return pd.DataFrame({"region_id": key[0], "i": ids[good].astype("int32"), "beta": beta, "bread": list(bread)})


def fit_index(trades: DataFrame, region: str = "region_id") -> DataFrame:
    """(region_id, deal_ym, value, lo, hi, n_obs): 100 exp(beta) of each month against the first, with 95 % intervals."""
    # Seven aggregates read the sample, and three steps the coefficients: both are written once, to the shared folder.
    rows = written(sample(trades.select(region, "complex_key", "deal_ym", "floor", "area_m2", "ppm2"), region).withColumnRenamed(region, "region_id"))
    beta = written(moments(rows).groupBy("region_id").applyInPandas(_solve, "region_id string, i int, beta double, bread array<double>"))
    lookup = beta.groupBy("region_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "beta"))).alias("b"))
    df = _long(rows).join(F.broadcast(lookup), "region_id")
    fitted = F.aggregate("cols", F.lit(0.0), lambda s, c: s + F.coalesce(F.element_at("b", c), F.lit(0.0)))
    resid = df.withColumn("r", F.col("y") - fitted).drop("b")
    own = resid.groupBy("region_id", "complex_key").agg(F.avg("r").alias("mean"))
    e = resid.join(own, ["region_id", "complex_key"]).withColumn("e", F.col("r") - F.col("mean"))
    scores = e.withColumn("i", F.explode("cols")).groupBy("region_id", "complex_key", "i").agg(F.sum("e").alias("x"))
    lists = scores.groupBy("region_id", "complex_key").agg(F.collect_list(F.struct("i", "x")).alias("xs"))
    meat = _gram(lists.select("region_id", "xs", F.lit(1.0).alias("w"), F.lit(0.0).alias("y")))

    sizes = rows.groupBy("region_id", "complex_key").count().groupBy("region_id").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("g"))

    def errors(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("i")
        if left.empty:
            return pd.DataFrame({"region_id": [], "i": [], "beta": [], "se": []})
        at = {int(c): k for k, c in enumerate(left["i"])}
        bread, m = np.stack(left["bread"].to_numpy()), np.zeros((len(at), len(at)))
        for i, j, v in zip(right["i"], right["j"], right["v"], strict=True):
            if i in at and j in at:
                m[at[i], at[j]] = v
        n, g = (int(left[c].iloc[0]) for c in ("n", "g"))
        adj = g / (g - 1) * (n - 1) / max(n - g - len(at), 1) if g > 1 else 0.0
        se = np.sqrt(np.clip(np.diag(adj * bread @ m @ bread), 0, None))
        return pd.DataFrame({"region_id": key[0], "i": left["i"].astype("int32"), "beta": left["beta"], "se": se})

    sized = beta.join(F.broadcast(sizes), "region_id")
    solved = sized.groupBy("region_id").cogroup(meat.groupBy("region_id")).applyInPandas(errors, "region_id string, i int, beta double, se double")
    months = rows.groupBy("region_id", "deal_ym", "m").agg(F.count(F.lit(1)).alias("n_obs"))
    out = months.join(solved.withColumnRenamed("i", "m"), ["region_id", "m"], "left").where((F.col("m") == 0) | F.col("beta").isNotNull())
    b, s = F.coalesce("beta", F.lit(0.0)), F.coalesce("se", F.lit(0.0))
    return out.select("region_id", "deal_ym", (F.exp(b) * 100).alias("value"), (F.exp(b - s * Z95) * 100).alias("lo"), (F.exp(b + s * Z95) * 100).alias("hi"), "n_obs")


def monthly_change(index: DataFrame, key: str = "region_id") -> DataFrame:
    """Change against the month before, only where it is there (H6)."""
    own = W.partitionBy(key).orderBy("deal_ym")
    df = index.withColumn("gap", month_no(F.col("deal_ym")) - F.lag(month_no(F.col("deal_ym"))).over(own)).withColumn("was", F.lag("value").over(own))
    return df.where((F.col("gap") == 1) & (F.col("was") > 0)).select(key, "deal_ym", (F.col("value") / F.col("was") - 1).alias("change"))


def validate_index(index: DataFrame, reference: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, n_months, corr_mom, direction_match) against a reference; null below six common months (H7)."""
    both = monthly_change(index, key).join(monthly_change(reference, key).withColumnRenamed("change", "ref"), [key, "deal_ym"])
    agg = both.groupBy(key).agg(F.count(F.lit(1)).alias("n_months"), F.corr("change", "ref").alias("c"), F.avg((F.signum("change") == F.signum("ref")).cast("double")).alias("d"))
    return agg.select(key, "n_months", F.when(F.col("n_months") >= 6, F.nanvl("c", F.lit(None))).alias("corr_mom"), F.when(F.col("n_months") >= 6, F.col("d")).alias("direction_match"))
