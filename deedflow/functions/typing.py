"""Typing of source strings: blanks, amounts, integers, areas, dates, and whole trade and rent rows.

Parsers never raise inside a plan. A value that is present but unreadable becomes null and is named in the row's
`errors` array, so that validation can count and quarantine rows without failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of the source's schema versions.
TRADE_V1 = "sggCd umdNm aptNm jibun excluUseAr dealYear dealMonth dealDay dealAmount floor buildYear cdealType cdealDay dealingGbn estateAgentSggNm rgstDate aptDong slerGbn buyerGbn landLeaseholdGbn".split()
TRADE_V2 = TRADE_V1 + "aptSeq umdCd landCd bonbun bubun roadNm roadNmSggCd roadNmCd roadNmSeq roadNmbCd roadNmBonbun roadNmBubun".split()
RENT_V1 = "sggCd umdNm aptNm jibun excluUseAr dealYear dealMonth dealDay deposit monthlyRent floor buildYear contractTerm contractType useRRRight preDeposit preMonthlyRent aptSeq roadnm roadnmsggcd roadnmcd roadnmseq roadnmbcd roadnmbonbun roadnmbubun".split()
TRADE_REQUIRED = "sggCd umdNm aptNm dealYear dealMonth dealDay dealAmount".split()
RENT_REQUIRED = "sggCd umdNm aptNm dealYear dealMonth dealDay deposit monthlyRent".split()
ENRICHMENT = {"apt_seq": "aptSeq", "umd_cd": "umdCd", "land_cd": "landCd", "bonbun": "bonbun", "bubun": "bubun", "road_nm": "roadNm", "road_nm_cd": "roadNmCd", "road_nm_bonbun": "roadNmBonbun", "road_nm_bubun": "roadNmBubun"}


def stripped(c: Column) -> Column:
    """Without surrounding white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def amount(c: Column, signed: bool = False) -> Column:
    """Integer with optional thousands commas; null if it is anything else."""
    digits = F.replace(blank_to_null(c), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^-?[0-9]+$" if signed else r"^[0-9]+$"), digits.try_cast("bigint"))


def integer(c: Column) -> Column:
    return amount(F.when(~F.contains(c, F.lit(",")), c), signed=True)


def area(c: Column) -> Column:
    """decimal(9,4), halves away from zero."""
    return blank_to_null(c).try_cast("decimal(20,10)").try_cast("decimal(9,4)")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def short_date(c: Column) -> Column:
    """YY.M.D of this century; null for days that do not exist."""
    s = blank_to_null(c)
    part = lambda k: F.regexp_extract(s, r"^([0-9]{2})\.([0-9]{1,2})\.([0-9]{1,2})$", k)
    return F.when(part(1) != "", _date(F.concat(F.lit("20"), part(1)), part(2), part(3)))


def deal_date(y: Column, m: Column, d: Column) -> Column:
    return _date(*(integer(c).cast("string") for c in (y, m, d)))


def _errors(raw: dict[str, Column], parsed: dict[str, Column]) -> Column:
    """Names of the fields whose value is present and unreadable."""
    return F.filter(F.array(*(F.when(blank_to_null(raw[k]).isNotNull() & v.isNull(), F.lit(k)) for k, v in parsed.items())), lambda x: x.isNotNull())


def _missing(raw: dict[str, Column], required: list[str]) -> Column:
    return F.filter(F.array(*(F.when(blank_to_null(raw[k]).isNull(), F.lit(k)) for k in required)), lambda x: x.isNotNull())


def _raw(row: Column, names: list[str]) -> dict[str, Column]:
    return {n: row[n] for n in names}


def typed_trades(df: DataFrame, row: str = "row") -> DataFrame:
    """df with a map column `row` of source strings, as typed trade columns, missing and errors."""
    r = _raw(F.col(row), TRADE_V2)
    text = lambda n: blank_to_null(r[n])
    numbers = {"dealAmount": amount(r["dealAmount"]), "excluUseAr": area(r["excluUseAr"]), "floor": integer(r["floor"]), "buildYear": integer(r["buildYear"]), "cdealDay": short_date(r["cdealDay"]), "rgstDate": short_date(r["rgstDate"])}
    dated = deal_date(r["dealYear"], r["dealMonth"], r["dealDay"])
    cols = {
        "sgg_cd": text("sggCd"), "umd_nm": text("umdNm"), "apt_nm": text("aptNm"), "jibun": text("jibun"), "area_m2": numbers["excluUseAr"], "deal_date": dated,
        "price_manwon": numbers["dealAmount"], "floor": numbers["floor"].cast("int"), "build_year": numbers["buildYear"].cast("int"), "is_cancelled": text("cdealType").eqNullSafe("O"),
        "cancel_date": numbers["cdealDay"], "registered_date": numbers["rgstDate"], "apt_dong": text("aptDong"), "deal_kind": text("dealingGbn"), "agent_sgg_nm": text("estateAgentSggNm"),
        "seller_type": text("slerGbn"), "buyer_type": text("buyerGbn"), "land_leasehold": text("landLeaseholdGbn") == "Y", **{k: text(v) for k, v in ENRICHMENT.items()},
    }
    rest = [F.col(c) for c in df.columns if c != row]
    return df.select(*rest, *(v.alias(k) for k, v in cols.items()), _missing(r, TRADE_REQUIRED).alias("missing"), _errors(r, numbers | {"dealDay": dated}).alias("errors"))


def typed_rents(df: DataFrame, row: str = "row") -> DataFrame:
    """As typed_trades, for leases: current amounts are unsigned, previous ones may be negative."""
    r = _raw(F.col(row), RENT_V1)
    text = lambda n: blank_to_null(r[n])
    numbers = {"deposit": amount(r["deposit"]), "monthlyRent": amount(r["monthlyRent"]), "preDeposit": amount(r["preDeposit"], True), "preMonthlyRent": amount(r["preMonthlyRent"], True), "excluUseAr": area(r["excluUseAr"]), "floor": integer(r["floor"]), "buildYear": integer(r["buildYear"])}
    dated = deal_date(r["dealYear"], r["dealMonth"], r["dealDay"])
    cols = {
        "sgg_cd": text("sggCd"), "umd_nm": text("umdNm"), "apt_nm": text("aptNm"), "jibun": text("jibun"), "area_m2": numbers["excluUseAr"], "deal_date": dated, "deposit_manwon": numbers["deposit"],
        "monthly_rent_manwon": numbers["monthlyRent"], "floor": numbers["floor"].cast("int"), "build_year": numbers["buildYear"].cast("int"), "contract_type": text("contractType"), "contract_term": text("contractTerm"),
        "use_rr_right": text("useRRRight"), "pre_deposit_manwon": numbers["preDeposit"], "pre_monthly_rent_manwon": numbers["preMonthlyRent"], "apt_seq": text("aptSeq"), "road_nm": text("roadnm"),
    }
    rest = [F.col(c) for c in df.columns if c != row]
    return df.select(*rest, *(v.alias(k) for k, v in cols.items()), _missing(r, RENT_REQUIRED).alias("missing"), _errors(r, numbers | {"dealDay": dated}).alias("errors"))


def schema_version(df: DataFrame, row: str, by: list[str], versions: dict[int, list[str]]) -> DataFrame:
    """(by, schema_ver): the earliest version whose fields hold all observed ones; null if none does."""
    seen = df.select(*by, F.explode(F.map_keys(row)).alias("k")).groupBy(*by).agg(F.collect_set("k").alias("ks"))
    pick = F.coalesce(*(F.when(F.size(F.array_except("ks", F.array(*map(F.lit, fields)))) == 0, F.lit(v)) for v, fields in sorted(versions.items())))
    return seen.select(*by, pick.alias("schema_ver"))
