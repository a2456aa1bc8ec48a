"""Region lists: leaves, official names, aliases and short names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.functions.keys import display_text


def derive_regions(rows: DataFrame) -> DataFrame:
    """Districts with province and names, and whether they are leaves: no other district's name starts with theirs.

    rows: region_cd, sido_cd, sgg_cd, umd_cd, ri_cd, locatadd_nm. A name's prefixes are listed and joined by equality,
    so no pair of districts is compared.
    """
    whole = (F.col("umd_cd") == "000") & (F.col("ri_cd") == "00")
    sido = rows.where(whole & (F.col("sgg_cd") == "000")).select("sido_cd", F.trim("locatadd_nm").alias("sido_nm"))
    sgg = rows.where(whole & (F.col("sgg_cd") != "000")).select(F.substring("region_cd", 1, 5).alias("sgg_cd"), "sido_cd", F.trim("locatadd_nm").alias("full_nm"))
    words = F.split("full_nm", " ")
    prefixes = sgg.withColumn("w", words).where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("p")).distinct()
    df = sgg.join(F.broadcast(sido), "sido_cd", "left").join(prefixes, sgg["full_nm"] == prefixes["p"], "left")
    # A province without a row of its own is its only district.
    name = F.when(F.col("full_nm").startswith(F.concat("sido_nm", F.lit(" "))), F.trim(F.expr("substring(full_nm, length(sido_nm) + 1)"))).otherwise(F.col("full_nm"))
    return df.select("sgg_cd", "sido_cd", F.coalesce("sido_nm", "full_nm").alias("sido_nm"), name.alias("sgg_nm"), "full_nm", F.col("p").isNull().alias("is_leaf"))


def official_names(rows: DataFrame) -> DataFrame:
    """(sgg_cd, name): neighbourhood names without province and district."""
    named = rows.select(F.substring("region_cd", 1, 5).alias("sgg_cd"), "umd_cd", "ri_cd", F.col("sgg_cd").alias("s"), display_text(F.col("locatadd_nm")).alias("nm"))
    full = named.where("umd_cd = '000' and ri_cd = '00' and s <> '000'").select("sgg_cd", F.col("nm").alias("full"))
    return named.where("umd_cd <> '000'").join(F.broadcast(full), "sgg_cd").where(F.col("nm").startswith(F.concat("full", F.lit(" ")))).select("sgg_cd", F.expr("substring(nm, length(full) + 2)").alias("name")).distinct()


def derive_aliases(official: DataFrame, observed: DataFrame) -> DataFrame:
    """(sgg_cd, new_nm, old_nm): an observed township that is no longer official, while the town of the same stem is.

    This one promotion is certain; any other change of name is left to a person.
    """
    seen = observed.select("sgg_cd", display_text(F.col("umd_nm")).alias("old_nm")).distinct()
    gone = seen.join(official.withColumnRenamed("name", "old_nm"), ["sgg_cd", "old_nm"], "left_anti")
    # The suffixes of township and town.
    new = F.regexp_replace("old_nm", r"^(\S+)면((?: \S+)*)$", "$1읍$2")
    return gone.withColumn("new_nm", new).where("new_nm <> old_nm").join(official.withColumnRenamed("name", "new_nm"), ["sgg_cd", "new_nm"], "left_semi").select("sgg_cd", "new_nm", "old_nm")


def match_short_names(short: DataFrame, sido: DataFrame, nation: str = "전국") -> DataFrame:
    """(short, sido_cd): the only province whose name starts with it, else the only one that holds its letters in order.

    Provinces are a fixed short list, broadcast as one array.
    """
    names = sido.agg(F.collect_set(F.struct("sido_cd", "sido_nm")).alias("ss"))
    in_order = F.concat(F.lit("^.*"), F.array_join(F.split(F.regexp_replace("short", r"([^\p{L}\p{N}])", r"\\$1"), "(?!^)"), ".*"))
    df = short.join(F.broadcast(names)).withColumn("like", in_order)
    starts = F.filter("ss", lambda s: s["sido_nm"].startswith(F.col("short")))
    holds = F.filter("ss", lambda s: F.regexp_like(s["sido_nm"], F.col("like")))
    df = df.withColumn("a", starts).withColumn("b", holds)
    code = F.when(F.col("short") == nation, "00").when(F.size("a") == 1, F.col("a")[0]["sido_cd"]).when((F.size("a") == 0) & (F.size("b") == 1), F.col("b")[0]["sido_cd"])
    return df.select("short", code.alias("sido_cd"))
