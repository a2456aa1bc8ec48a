"""The served layout: marts written once, by month, and read back with partition and column pruning.

All marts of a publish become current together, through one pointer. Serving queries read them and compute no mart; a
filter on deal_ym chooses directories, and inside a month rows are sorted by district, so that row groups prune. The
monthly marts have one row a region and month and are one sorted file each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from deedflow.plans import marts
from deedflow.sources.tables import Table


def publish_marts(table: Table, trades: DataFrame, rents: DataFrame, words: dict[str, str]) -> int:
    """Writes trade, region_month, rollup_month and the same of leases (rent, region_rent_month, rent_rollup_month).

    trades and rents: current rows. The monthly marts are computed from the served rows as written, so each source is
    read once. words: renewal, new and used, the values that the lease marts count.
    """
    staged = {"trade": table.stage_months("trade", marts.trade_serving(trades), ["sgg_cd", "deal_date", "trade_id"]), "rent": table.stage_months("rent", marts.rent_serving(rents), ["sgg_cd", "deal_date", "rent_id"])}
    t, r = (table.read_path(staged[name]) for name in ("trade", "rent"))
    monthly = {
        "region_month": (marts.region_month(t), "sgg_cd"), "rollup_month": (marts.rollup_month(t), "region_id"),
        "region_rent_month": (marts.region_rent_month(r, **words), "sgg_cd"), "rent_rollup_month": (marts.rent_rollup_month(r, **words), "region_id"),
    }
    staged |= {name: table.stage_whole(name, df, ["deal_ym", key]) for name, (df, key) in monthly.items()}
    return table.commit({(name, "*"): path for name, path in staged.items()})
