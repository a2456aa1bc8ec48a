"""Control rules: priorities, budget packing, rate limits and plan limits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("incremental", "recheck", "backfill")


def _age(ym: str, today: dt.date) -> int:
    return today.year * 12 + today.month - int(ym[:4]) * 12 - int(ym[4:])


def priority(ym: str, today: dt.date) -> str:
    age = _age(ym, today)
    return ORDER[(age >= 3) + (age >= 12)]


def priority_of(ym: Column, today: Column) -> Column:
    age = F.year(today) * 12 + F.month(today) - F.substring(ym, 1, 4).cast("int") * 12 - F.substring(ym, 5, 2).cast("int")
    return F.when(age < 3, ORDER[0]).when(age < 12, ORDER[1]).otherwise(ORDER[2])


def ceilings(cap: int, districts: int, recheck: bool) -> dict[str, int]:
    """Calls that each priority may use: lower ones leave the shares of those above them."""
    fresh = 3 * districts
    return {"incremental": cap, "recheck": max(cap - fresh, 0), "backfill": max(cap - fresh - 12 * districts * recheck, 0)}


@dataclass(frozen=True)
class Run:
    ym: str
    kind: str
    districts: tuple[str, ...] = ()


def plan(due: Iterable[tuple[str, str, str]], today: dt.date, used: int, limits: dict[str, int], busy: set[str], unpublished: Iterable[str]) -> list[Run]:
    """Runs for due (month, district, status) rows, greedily packed under the limits: by priority, retries before others
    of it, latest month first. A month that does not fit is passed over. Months that only need publishing follow."""
    months: dict[str, set[str]] = {}
    retry: set[str] = set()
    for ym, district, status in due:
        months.setdefault(ym, set()).add(district)
        if status == "RETRY":
            retry.add(ym)
    out = []
    for ym in sorted(months, key=lambda m: (ORDER.index(priority(m, today)) - (m in retry), -int(m))):
        kind = priority(ym, today)
        if ym not in busy and used + len(months[ym]) <= limits[kind]:
            used += len(months[ym])
            out.append(Run(ym, "retry" if ym in retry and kind != ORDER[0] else kind, tuple(sorted(months[ym]))))
    taken = busy | {r.ym for r in out}
    return out + [Run(ym, "publish-only") for ym in unpublished if ym not in taken]


def sliding_rate(calls: DataFrame, key: str = "client_id", at: str = "at", window_s: int = 60) -> DataFrame:
    """Each call with the limiter's estimate: the window before, weighted by what of it still counts, plus this window so far."""
    sec = F.unix_micros(F.col(at).cast("timestamp"))
    df = calls.withColumn("w", F.floor(sec / (window_s * 1_000_000))).withColumn("frac", (sec % (window_s * 1_000_000)) / float(window_s * 1_000_000))
    counts = df.groupBy(key, "w").agg(F.count(F.lit(1)).alias("prev")).withColumn("w", F.col("w") + 1)
    so_far = F.count(F.lit(1)).over(W.partitionBy(key, "w").orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    return df.withColumn("cur", so_far).join(counts, [key, "w"], "left").withColumn("estimate", F.coalesce("prev", F.lit(0)) * (1 - F.col("frac")) + F.col("cur")).drop("w", "frac", "cur", "prev")


def within_plan(months: int, page_size: int, rows: int, limits: dict[str, int]) -> list[str]:
    """Names of the plan limits that a request exceeds."""
    asked = {"range_months": months, "page_size": page_size, "rows": rows}
    return [k for k, v in asked.items() if k in limits and v > limits[k]]
