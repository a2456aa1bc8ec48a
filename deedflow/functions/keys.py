"""Text normalisation, fingerprints, duplicate numbers and public ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.functions.typing import stripped

# The mutable fields whose change makes a new version, in hash order.
TRADE_MUTABLE = "is_cancelled cancel_date registered_date apt_dong deal_kind agent_sgg_nm seller_type buyer_type build_year land_leasehold".split()
RENT_MUTABLE = "contract_type contract_term use_rr_right pre_deposit_manwon pre_monthly_rent_manwon build_year".split()


def _nfkc(s: pd.Series) -> pd.Series:
    out = s.copy()
    some = s.notna()
    out[some] = s[some].map(lambda x: unicodedata.normalize("NFKC", x))
    return out


#: Text of ASCII, Hangul syllables and unified ideographs alone is in NFKC form already.
_SETTLED = r"^[\x00-\x7F\uAC00-\uD7A3\u4E00-\u9FFF]*$"


def nfkc(c: Column) -> Column:
    """NFKC form. The JVM has no built-in for it: an Arrow-batched function does it, and is sent only the texts that can
    change; for all others it is sent null."""
    udf = F.pandas_udf(_nfkc, "string")
    settled = c.rlike(_SETTLED)
    return F.when(settled, c).otherwise(udf(F.when(~settled, c)))


def norm_text(c: Column) -> Column:
    """NFKC, no white space, lower case; null becomes empty."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s+", ""))


def norm_lot(c: Column) -> Column:
    """norm_text without leading zeros in any run of digits."""
    return F.regexp_replace(norm_text(c), r"(?<![0-9])0+(?=[0-9])", "")


def display_text(c: Column) -> Column:
    return stripped(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def shown(df: DataFrame, name: str) -> Column:
    """A part of a hash: null is empty, booleans are True and False."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "boolean":
        c = F.when(c, "True").when(~c, "False")
    return F.coalesce(c.cast("string"), F.lit(""))


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def with_names(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """df with the normalised place columns that keys are made of: k_umd (by its old name if aliased), k_lot, k_apt.

    aliases: (sgg_cd, new_nm normalised, old_nm).
    """
    out = df.withColumns({"k_umd": norm_text(F.col("umd_nm")), "k_lot": norm_lot(F.col("jibun")), "k_apt": norm_text(F.col("apt_nm"))})
    if aliases is None:
        return out
    known = aliases.select(F.col("sgg_cd").alias("a_sgg"), F.col("new_nm").alias("a_new"), norm_text(F.col("old_nm")).alias("a_old"))
    out = out.join(known, (F.col("sgg_cd") == F.col("a_sgg")) & (F.col("k_umd") == F.col("a_new")), "left")
    return out.withColumn("k_umd", F.coalesce("a_old", "k_umd")).drop("a_sgg", "a_new", "a_old")


def _keyed(df: DataFrame, key: str, ident: str, prefix: str, money: list[str], mutable: list[str], aliases: DataFrame | None) -> DataFrame:
    named = with_names(df, aliases)
    place = [F.coalesce("sgg_cd", F.lit("")), F.col("k_umd"), F.col("k_lot"), F.col("k_apt")]
    out = named.withColumn("complex_key", F.concat(F.lit("c_"), F.substring(joined_hash(*place), 1, 20)))
    out = out.withColumn(key, joined_hash(*place, *(shown(named, c) for c in ["area_m2", "deal_date", *money, "floor"])))
    out = out.withColumn("attr_hash", F.substring(joined_hash(*(shown(named, c) for c in mutable)), 1, 32))
    out = out.withColumn("deal_ym", F.date_format("deal_date", "yyyyMM"))
    # The rank inside equal fingerprints follows the attributes alone, so input order does not matter.
    same = W.partitionBy("sgg_cd", "deal_ym", key).orderBy("attr_hash")
    out = out.withColumn("dup_seq", (F.row_number().over(same) - 1).cast("int"))
    return out.withColumn(ident, F.concat(F.lit(prefix), F.concat_ws("-", "sgg_cd", "deal_ym", F.substring(key, 1, 16), F.col("dup_seq").cast("string")))).drop("k_umd", "k_lot", "k_apt")


def keyed_trades(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Typed trades with complex_key, trade_key, attr_hash, deal_ym, dup_seq and trade_id."""
    return _keyed(df, "trade_key", "trade_id", "", ["price_manwon"], TRADE_MUTABLE, aliases)


def keyed_rents(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    return _keyed(df, "rent_key", "rent_id", "r", ["deposit_manwon", "monthly_rent_manwon"], RENT_MUTABLE, aliases)


def duplicate_groups(keyed: DataFrame, key: str = "trade_key") -> DataFrame:
    """One row: fingerprints that more than one row of a district and month has."""
    return keyed.where("dup_seq > 0").agg(F.count_distinct(key).alias("duplicate_groups"))


def id_month(c: Column, rent: bool = False) -> Column:
    """The month partition that an id names; null if the id is malformed."""
    m = F.regexp_extract(c, ("^r" if rent else "^") + r"[0-9]{5}-([0-9]{4}(?:0[1-9]|1[0-2]))-[0-9a-f]{16}-[0-9]+$", 1)
    return F.nullif(m, F.lit(""))
