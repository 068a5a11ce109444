"""Daily series that are mostly zero, kept as their observed days only: what is not observed within the calendar is zero.

Gaps are lengths between neighbouring days, sums before a day are range frames over day numbers, and days that anything can
change on are the observed ones and a few after each. Work follows the observations, not keys times days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar(df: DataFrame, day: str = "day") -> DataFrame:
    """One row: first and last day of all series; nulls for an empty table."""
    return df.agg(F.min(day).alias("_first"), F.max(day).alias("_last"))


def _with(df: DataFrame, span: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(span))  # one row


def gaps(df: DataFrame, by: Sequence[str], span: DataFrame, least: int = 1, day: str = "day") -> DataFrame:
    """Runs of days without a row, of at least so many: by, first, last, length. df: by and distinct days that are not null; span as from
    calendar(). Runs before a key's first day and after its last one count; a key without a day has no row at all."""
    w = W.partitionBy(*by).orderBy(day)
    # each day closes the gap before it; the last one opens one up to the calendar's end
    near = df.select(*by, day, F.lag(day).over(w).alias("_before"), F.lead(day).over(w).isNull().alias("_final"))
    near = _with(near, span)
    run = lambda a, b: F.struct(a.alias("first"), b.alias("last"), (F.datediff(b, a) + 1).cast("long").alias("length"))
    closed = run(F.coalesce(F.date_add("_before", 1), F.col("_first")), F.date_sub(day, 1))
    tail = F.when(F.col("_final"), F.array(run(F.date_add(day, 1), F.col("_last")))).otherwise(F.array().cast("array<struct<first:date,last:date,length:bigint>>"))
    return near.select(*by, F.inline(F.concat(F.array(closed), tail))).where(F.col("length") >= least)


def touched(df: DataFrame, by: Sequence[str], value: str, span: DataFrame, back: int, day: str = "day") -> DataFrame:
    """The days on which a window over up to back days before sees anything: observed ones and, as zeros, back days after each
    within the calendar; with _age, the days of the calendar before. On all others value and window are zero."""
    each = _with(df, span).select(*by, F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_k"), day, value, "_first", "_last")
    each = each.select(*by, F.date_add(day, F.col("_k")).alias(day), F.when(F.col("_k") == 0, F.col(value)).alias(value), "_first", "_last").where(F.col(day) <= F.col("_last"))
    out = each.groupBy(*by, day, "_first").agg(F.coalesce(F.max(value), F.lit(0)).alias(value))
    return out.withColumn("_age", F.datediff(day, "_first")).drop("_first")


def before(value: str, by: Sequence[str], days: int, day: str = "day") -> Column:
    """Sum over so many calendar days before a day, whatever of them is observed."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-days, -1)), F.lit(0))


def near_zeros(df: DataFrame, events: DataFrame, by: Sequence[str], span: DataFrame, k: int, day: str = "day") -> DataFrame:
    """by and the days without a row that lie within k days of an event (by, day) and in the calendar; distinct."""
    around = _with(events, span).select(*by, "_first", "_last", F.explode(F.sequence(F.date_sub(day, k), F.date_add(day, k))).alias(day))
    around = around.where(F.col(day).between(F.col("_first"), F.col("_last"))).select(*by, day).distinct()
    return around.join(df.select(*by, day), [*by, day], "left_anti")
