"""Exact interpolated percentiles (G1) and percentiles of histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sorted_percentiles(df: DataFrame, by: list[str], value: str, pcts: dict[str, float]) -> DataFrame:
    """by, n and the two neighbours of each rank, from one sort of each group's different values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    group = W.partitionBy(*by)
    ranked = counts.withColumn("end", F.sum("c").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(group))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *_picks(pcts))


def _ranks(pcts: dict[str, float]) -> dict[str, Column]:
    return {f"{name}_{side}": f((F.col("n") - 1) * F.lit(float(p))) for name, p in pcts.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}


def _picks(pcts: dict[str, float]) -> list[Column]:
    """The value that covers each rank, of values with their counts c and running counts end."""
    return [F.max(F.when((F.col("end") - F.col("c") <= r) & (r < F.col("end")), F.col("v"))).alias(k) for k, r in _ranks(pcts).items()]


def exact_percentiles(df: DataFrame, by: list[str], value: str, pcts: dict[str, float], wide: bool = False, step: float = 1.0) -> DataFrame:
    """by, n, and for each name the percentile at rank (n - 1) p between its two neighbours.

    Groups of a district, a complex or a band are sorted whole. wide groups, a month of the nation or of a province, grow
    with all the data and are dealt by part as well, see below. The results are the same, bit for bit those of the sorted
    list.
    """
    picked = _dealt_percentiles(df, by, value, pcts, step) if wide else _sorted_percentiles(df, by, value, pcts)
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in pcts.items()}
    return picked.select(*by, "n", *((F.col(f"{k}_lo") + (a - F.floor(a)) * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).alias(k) for k, a in at.items()))


def _dealt_percentiles(df: DataFrame, by: list[str], value: str, pcts: dict[str, float], step: float) -> DataFrame:
    """by, n and the two neighbours of each rank, without a sort of any whole group.

    Rows are dealt by group and part, a part being a stretch of `step` of the values, so a group of any size, such as a
    nation, is spread over its parts. Counts by part tell which parts hold a wanted rank, and only the values of those are
    sorted, part by part. The counts, the join and the sort read the one exchange; what follows it is small. step changes
    no result.
    """
    # Rounding keeps the order of quotients, so no value falls into a lesser part than a smaller one.
    part = F.floor(F.greatest(F.least(F.col("v").cast("double") / F.lit(float(step)), F.lit(9e18)), F.lit(-9e18)))
    dealt = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")).withColumn("part", part).repartition(*by, "part")
    hist = dealt.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("pc"))
    group = W.partitionBy(*by)
    hist = hist.withColumn("start", F.sum("pc").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("pc")).withColumn("n", F.sum("pc").over(group))
    held = reduce(lambda x, y: x | y, ((F.col("start") <= r) & (r < F.col("start") + F.col("pc")) for r in _ranks(pcts).values()))
    keys = [*by, "part"]
    wanted = hist.where(held).select(*(F.col(c).alias(f"_{c}") for c in keys), "start", "n")
    few = dealt.join(wanted, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)))
    counts = few.groupBy(*keys, "v", "start", "n").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("end", F.col("start") + F.sum("c").over(W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    return counts.groupBy(*by).agg(F.max("n").alias("n"), *_picks(pcts))


def nearest_rank(hist: DataFrame, by: list[str], value: str, weight: str, pcts: dict[str, float]) -> DataFrame:
    """by, total, and for each name the least value at which the running weight reaches p of the total."""
    group = W.partitionBy(*by)
    run = hist.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    run = run.withColumn("run", F.sum("w").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(group))
    return run.groupBy(*by).agg(F.max("total").alias("total"), *(F.min(F.when(F.col("run") >= F.col("total") * F.lit(float(p)), F.col("v"))).alias(k) for k, p in pcts.items()))
