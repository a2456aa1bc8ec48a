"""Monthly marts over trades and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.functions.values import month_no
from deedflow.operators.percentile import exact_percentiles

LOW = 5
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _flagged(df: DataFrame, value: str, sample: Column) -> DataFrame:
    """df with is_outlier: outside the nation-wide 0.1 % bounds of its month's sample."""
    # One row a month, so the bounds are far below any broadcast limit; the optimiser decides by their size.
    bounds = exact_percentiles(df.where(sample), ["deal_ym"], value, {"lo": 0.001, "hi": 0.999}, wide=True).select(F.col("deal_ym").alias("b_ym"), "lo", "hi")
    out = sample & ((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))
    return df.join(bounds, F.col("deal_ym") == F.col("b_ym"), "left").withColumn("is_outlier", F.coalesce(out, F.lit(False))).drop("b_ym", "lo", "hi")


def trade_serving(current: DataFrame) -> DataFrame:
    """Current trades with ppm2 and is_outlier."""
    ppm2 = F.when(F.col("area_m2") > 0, F.try_divide(F.col("price_manwon").cast("double"), F.col("area_m2").cast("double")))
    return _flagged(current.withColumn("ppm2", ppm2), "ppm2", ~F.col("is_cancelled") & (F.col("area_m2") > 0))


def priced(df: DataFrame) -> Column:
    return ~F.col("is_cancelled") & (F.col("area_m2") > 0) & ~F.col("is_outlier")


def _levels(df: DataFrame) -> DataFrame:
    """Each row once for its province and once for the nation: percentiles cannot be summed from districts."""
    return df.withColumn("region_id", F.explode(F.array(F.substring("sgg_cd", 1, 2), F.lit("00"))))


def _trade_month(serving: DataFrame, region: str) -> DataFrame:
    by, wide = [region, "deal_ym"], region == "region_id"
    sample = priced(serving)
    counts = serving.groupBy(*by).agg(F.count(F.lit(1)).alias("reported"), F.count_if(~F.col("is_cancelled")).alias("trades"), F.count_if("is_cancelled").alias("cancelled"), F.count_if(sample).alias("priced"), F.count_if("is_outlier").alias("outliers"))
    pct = exact_percentiles(serving.where(sample), by, "ppm2", QUARTILES, wide).drop("n")
    enough = lambda c: F.when(F.col("priced") >= LOW, F.col(c))
    return counts.join(pct, by, "left").select(*by, "reported", "trades", "cancelled", "priced", "outliers", enough("p25").alias("p25_ppm2"), enough("p50").alias("median_ppm2"), enough("p75").alias("p75_ppm2"), (F.col("priced") < LOW).alias("low_sample"))


def region_month(serving: DataFrame) -> DataFrame:
    return _trade_month(serving, "sgg_cd")


def rollup_month(serving: DataFrame) -> DataFrame:
    return _trade_month(_levels(serving), "region_id").withColumn("level", F.when(F.col("region_id") == "00", "nation").otherwise("sido"))


def rent_serving(current: DataFrame) -> DataFrame:
    """Current leases with is_jeonse (no monthly rent), deposit_ppm2 and is_outlier (jeonse only)."""
    ppm2 = F.when(F.col("area_m2") > 0, F.try_divide(F.col("deposit_manwon").cast("double"), F.col("area_m2").cast("double")))
    return _flagged(current.withColumns({"is_jeonse": F.col("monthly_rent_manwon") == 0, "deposit_ppm2": ppm2}), "deposit_ppm2", F.col("is_jeonse") & (F.col("area_m2") > 0))


def _rent_month(serving: DataFrame, region: str, renewal: str, new: str, used: str) -> DataFrame:
    by, wide = [region, "deal_ym"], region == "region_id"
    sample = F.col("is_jeonse") & (F.col("area_m2") > 0) & ~F.col("is_outlier")
    counts = serving.groupBy(*by).agg(
        F.count(F.lit(1)).alias("contracts"), F.count_if("is_jeonse").alias("jeonse"), F.count_if(~F.col("is_jeonse")).alias("wolse"), F.count_if(F.col("contract_type") == renewal).alias("renewals"),
        F.count_if(F.col("contract_type") == new).alias("new_contracts"), F.count_if(F.col("use_rr_right") == used).alias("rr_used"), F.count_if(sample).alias("jeonse_priced"), F.count_if("is_outlier").alias("outliers"),
    )
    jeonse = exact_percentiles(serving.where(sample), by, "deposit_ppm2", QUARTILES, wide).drop("n")
    monthly = serving.where(~F.col("is_jeonse")).select(*by, F.col("monthly_rent_manwon").cast("double").alias("rent"), F.col("deposit_manwon").cast("double").alias("deposit"))
    rent = exact_percentiles(monthly, by, "rent", {"rent50": 0.5}, wide).drop("n")
    deposit = exact_percentiles(monthly, by, "deposit", {"deposit50": 0.5}, wide).drop("n")
    of = lambda n, c: F.when(F.col(n) >= LOW, F.col(c))
    out = counts.join(jeonse, by, "left").join(rent, by, "left").join(deposit, by, "left")
    return out.select(*counts.columns, of("jeonse_priced", "p25").alias("jeonse_p25_ppm2"), of("jeonse_priced", "p50").alias("jeonse_median_ppm2"), of("jeonse_priced", "p75").alias("jeonse_p75_ppm2"), of("wolse", "rent50").alias("wolse_median_rent"), of("wolse", "deposit50").alias("wolse_median_deposit"), (F.col("jeonse_priced") < LOW).alias("low_sample"))


def region_rent_month(serving: DataFrame, renewal: str = "갱신", new: str = "신규", used: str = "사용") -> DataFrame:
    return _rent_month(serving, "sgg_cd", renewal, new, used)


def rent_rollup_month(serving: DataFrame, renewal: str = "갱신", new: str = "신규", used: str = "사용") -> DataFrame:
    return _rent_month(_levels(serving), "region_id", renewal, new, used).withColumn("level", F.when(F.col("region_id") == "00", "nation").otherwise("sido"))


def version_rows(history: DataFrame, columns: list[str]) -> DataFrame:
    """The history columns that are served."""
    return history.select(*columns)


def complex_summary(dim: DataFrame, current: DataFrame, regions: DataFrame) -> DataFrame:
    """Complexes of official regions with their number of valid trades; unknown leasehold stays null."""
    n = current.where(~F.col("is_cancelled")).groupBy("complex_key").agg(F.count(F.lit(1)).alias("trades"))
    return dim.join(F.broadcast(regions.select("sgg_cd").distinct()), "sgg_cd", "left_semi").join(n, "complex_key", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def source_latency(versions: DataFrame, first_fetch: DataFrame, regions: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """(metric, observed_date, sido_cd, reason, lag_days, n): days from contract to first sight (L1) and from cancellation
    to its first sight (L2), with the reason why a row has no usable lag; the first reason that applies wins.

    versions: trade_id, sgg_cd, deal_ym, deal_date, version, valid_from, is_cancelled, cancel_date. first_fetch:
    sgg_cd, deal_ym, first_fetch. regions: sgg_cd of the official districts; versions of others are left out.
    """
    versions = versions.join(regions.select("sgg_cd").distinct(), "sgg_cd", "left_semi")
    own = W.partitionBy("trade_id").orderBy("version")
    v = versions.withColumn("prev_from", F.lag("valid_from").over(own))
    # Both events come out of the one window pass: the first version, and the first cancelled one.
    v = v.withColumn("seen_cancelled", F.sum(F.col("is_cancelled").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    event = lambda m, base: F.struct(F.lit(m).alias("metric"), base.alias("base_date"))
    events = F.array_compact(F.array(F.when(F.col("version") == 1, event("L1", F.col("deal_date"))), F.when(F.col("is_cancelled") & (F.col("seen_cancelled") == 1), event("L2", F.col("cancel_date")))))
    obs = v.withColumn("e", F.explode(events)).join(first_fetch, ["sgg_cd", "deal_ym"])
    obs = obs.select("e.metric", "e.base_date", F.to_date(F.from_utc_timestamp("valid_from", zone)).alias("observed_date"), F.substring("sgg_cd", 1, 2).alias("sido_cd"), "deal_ym", "valid_from", "prev_from", "first_fetch")
    age = F.year("observed_date") * 12 + F.month("observed_date") - month_no(F.col("deal_ym"))
    reason = (
        F.when(F.col("valid_from") < F.col("prev_from"), "time_inverted").when(F.col("valid_from") <= F.col("first_fetch"), "initial_load")
        .when(F.col("base_date").isNull(), "no_base_date").when(age >= 3, "low_resolution").when(F.col("base_date") > F.col("observed_date"), "negative_lag").otherwise("")
    )
    lag = F.when(F.col("reason") == "", F.datediff("observed_date", "base_date"))
    return obs.withColumn("reason", reason).withColumn("lag_days", lag).groupBy("metric", "observed_date", "sido_cd", "reason", "lag_days").agg(F.count(F.lit(1)).alias("n"))
