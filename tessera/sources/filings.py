"""Filings of three sources to canonical observations: ticker, source, metric, period, period_end, value, unit, as_of.

Payloads come as rows (ticker, payload); a payload is JSON text. Dynamic keys are maps in the schema, so that one
schema reads all companies. Rows that no rule knows go; a unit without a rule stops the query, as a guessed scale is
worse than none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fiscal_label
from ..operators.windows import latest

#: Factors of declared units, and other spellings of the unit per share.
UNITS = {"USD": 1.0, "USD/share": 1.0, "thousands of USD": 1e3, "millions of USD": 1e6}
PER_SHARE = ("USD/shares", "USD / shares", "USD/share")

#: Tags of the regulator's facts in order of priority, and the metric of each.
TAGS = {
    "Revenues": "revenue", "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue", "NetIncomeLoss": "net_income", "EarningsPerShareDiluted": "eps_diluted",
    "Assets": "total_assets", "NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow",
}

#: Fixed values: (statement, field, metric) of the two vendors.
FMP = (("income_statement", "revenue", "revenue"), ("income_statement", "netIncome", "net_income"), ("income_statement", "epsdiluted", "eps_diluted"),
       ("balance_sheet", "totalAssets", "total_assets"), ("cash_flow", "operatingCashFlow", "operating_cash_flow"))
POLYGON = (("income_statement", "revenues", "revenue"), ("income_statement", "net_income_loss", "net_income"), ("income_statement", "diluted_earnings_per_share", "eps_diluted"),
           ("balance_sheet", "assets", "total_assets"), ("cash_flow_statement", "net_cash_flow_from_operating_activities", "operating_cash_flow"))

#: Days that a year of a duration fact may span.
YEAR = (300, 400)

_FACT = "array<struct<form string, fp string, start string, `end` string, val double, filed string>>"
_EDGAR = f"facts struct<`us-gaap`: map<string, struct<units: map<string, {_FACT}>>>>"
_FMP_ROW = "array<struct<period: string, calendarYear: string, `date`: string, fillingDate: string, " + ", ".join(f"{f}: double" for _, f, _ in FMP) + ">>"
_FMP = "symbol string, " + ", ".join(f"{s} {_FMP_ROW}" for s in ("income_statement", "balance_sheet", "cash_flow"))
_POLYGON = "results array<struct<timeframe: string, fiscal_year: string, end_date: string, filing_date: string, financials: map<string, map<string, struct<value: double, unit: string>>>>>"

COLUMNS = ("ticker", "source", "metric", "period", "period_end", "value", "unit", "as_of")


def scaled(value: Column, unit: Column) -> tuple[Column, Column]:
    """Value in plain units and its canonical unit; a unit without a rule raises."""
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    one = F.when(unit.isin(*PER_SHARE), "USD/share").otherwise(unit)
    factor = F.coalesce(F.try_element_at(known, one), F.raise_error(F.concat(F.lit("no rule for unit "), one)).cast("double"))
    return value * factor, F.when(one == "USD/share", one).otherwise("USD")


def regulator(payloads: DataFrame) -> DataFrame:
    """Annual facts of yearly reports; of several for one metric and period the latest filed, then the tag of higher priority."""
    x = payloads.select("ticker", F.from_json("payload", _EDGAR)["facts"]["us-gaap"].alias("g")).select("ticker", F.explode("g").alias("tag", "spec")).where(F.col("tag").isin(*TAGS))
    x = x.select("ticker", "tag", F.explode("spec.units").alias("unit", "facts")).select("ticker", "tag", "unit", F.explode("facts").alias("f"))
    start, end = F.to_date("f.start"), F.to_date("f.end")
    x = x.where((F.col("f.form") == "10-K") & (F.col("f.fp") == "FY") & (F.col("f.start").isNull() | F.datediff(end, start).between(*YEAR)))
    value, unit = scaled(F.col("f.val"), F.col("unit"))
    names = F.create_map(*[F.lit(v) for kv in TAGS.items() for v in kv])
    place = F.create_map(*[F.lit(v) for n, k in enumerate(TAGS) for v in (k, n)])
    x = x.select(F.upper("ticker").alias("ticker"), F.lit("edgar").alias("source"), names[F.col("tag")].alias("metric"), fiscal_label(end).alias("period"), end.alias("period_end"),
                 value.alias("value"), unit.alias("unit"), F.coalesce("f.filed", "f.end").alias("as_of"), F.coalesce("f.filed", F.lit("")).alias("_filed"), place[F.col("tag")].alias("_place"))
    return latest(x, ["ticker", "metric", "period"], [F.desc("_filed"), F.asc("_place"), F.desc("period_end"), F.desc("value")]).select(*COLUMNS)


def statements(payloads: DataFrame) -> DataFrame:
    """Raw reported values by statement; the source's own fiscal label is taken at its word."""
    p = F.from_json("payload", _FMP)
    x = payloads.select(F.upper(F.coalesce(F.nullif(p["symbol"], F.lit("")), F.col("ticker"))).alias("ticker"), p.alias("p"))
    out = []
    for name in dict.fromkeys(s for s, _, _ in FMP):
        items = [F.struct(F.lit(m).alias("metric"), F.col(f"r.{f}").alias("value")) for s, f, m in FMP if s == name]
        rows = x.select("ticker", F.explode(f"p.{name}").alias("r")).where("r.period = 'FY'").select("ticker", "r", F.explode(F.array(*items)).alias("i")).where("i.value is not null")
        unit = F.when(F.col("i.metric") == "eps_diluted", "USD/share").otherwise("USD")
        out.append(rows.select("ticker", F.lit("fmp").alias("source"), "i.metric", F.concat(F.lit("FY"), "r.calendarYear").alias("period"), F.to_date("r.date").alias("period_end"),
                               "i.value", unit.alias("unit"), F.coalesce(F.nullif("r.fillingDate", F.lit("")), "r.date").alias("as_of")))
    return reduce(DataFrame.unionByName, out)


def financials(payloads: DataFrame) -> DataFrame:
    """Annual line items, each with its own declared unit."""
    x = payloads.select(F.upper("ticker").alias("ticker"), F.explode(F.from_json("payload", _POLYGON)["results"]).alias("r")).where("r.timeframe = 'annual'")
    node = lambda s, i: F.try_element_at(F.try_element_at(F.col("r.financials"), F.lit(s)), F.lit(i))
    items = [F.struct(F.lit(m).alias("metric"), node(s, i)["value"].alias("value"), F.coalesce(node(s, i)["unit"], F.lit("USD")).alias("declared")) for s, i, m in POLYGON]
    x = x.select("ticker", "r", F.explode(F.array(*items)).alias("i")).where("i.value is not null")
    value, unit = scaled(F.col("i.value"), F.col("i.declared"))
    return x.select("ticker", F.lit("polygon").alias("source"), "i.metric", F.concat(F.lit("FY"), "r.fiscal_year").alias("period"), F.to_date("r.end_date").alias("period_end"),
                    value.alias("value"), unit.alias("unit"), F.coalesce(F.nullif("r.filing_date", F.lit("")), "r.end_date").alias("as_of"))


#: Readers by source; another source is another entry.
NORMALIZERS = {"edgar": regulator, "fmp": statements, "polygon": financials}


def canonical(payloads: DataFrame) -> DataFrame:
    """Observations of rows (source, ticker, payload); sources without a reader give none."""
    return reduce(DataFrame.unionByName, [read(payloads.where(F.col("source") == name).select("ticker", "payload")) for name, read in NORMALIZERS.items()])
