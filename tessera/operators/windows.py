"""Window operators. Every window has a total order that the caller names; none spans all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentile_rank(value: str, by: Sequence[str]) -> Column:
    """Average rank over the present values of a group, in percent; null for null."""
    present = F.col(value).isNotNull()
    w = W.partitionBy(*by, present)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, F.col(value))) - 1) / 2
    return F.when(present, 100.0 * rank / F.count("*").over(w))


def trailing(agg: Column, by: Sequence[str], order: Sequence[str], rows: int) -> Column:
    """An aggregate of up to so many rows before this one."""
    return agg.over(W.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1))


def trailing_z(value: str, by: Sequence[str], order: Sequence[str], rows: int, floor: float | None = None) -> Column:
    """Distance from the mean of the rows before, in their population deviations (at least floor); infinite if these are
    zero, null without rows before."""
    sd = trailing(F.stddev_pop(value), by, order, rows)
    far = F.col(value) - trailing(F.avg(value), by, order, rows)
    if floor is not None:
        return far / F.greatest(sd, F.lit(floor))
    return F.when(sd > 0, far / sd).when(sd == 0, F.lit(float("inf")))


def both_before(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Mean of the two rows before; null unless both are there and not null."""
    w = W.partitionBy(*by).orderBy(*order)
    return (F.lag(value, 1).over(w) + F.lag(value, 2).over(w)) / 2


def gap_fill(flag: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """A flag that is also set in a single missing period between two present ones."""
    w = W.partitionBy(*by).orderBy(*order)
    off = F.lit(False)
    return F.col(flag) | (F.coalesce(F.lag(flag).over(w), off) & F.coalesce(F.lead(flag).over(w), off))


def islands(df: DataFrame, flag: str, by: Sequence[str], order: str) -> DataFrame:
    """Runs of consecutive rows with the flag: by, first and last order value, length."""
    w = W.partitionBy(*by).orderBy(order)
    runs = df.withColumn("_n", F.row_number().over(w)).where(flag).withColumn("_run", F.col("_n") - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each group, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def both_ends(df: DataFrame, value: str, by: Sequence[str], tie: str, keep: int) -> DataFrame:
    """Rows among the keep highest or lowest of their group, with both ranks."""
    w = W.partitionBy(*by)
    ranks = df.withColumn("rank_high", F.rank().over(w.orderBy(F.desc(value), tie))).withColumn("rank_low", F.rank().over(w.orderBy(value, tie)))
    return ranks.where((F.col("rank_high") <= keep) | (F.col("rank_low") <= keep))


def dense(keys: DataFrame, periods: DataFrame) -> DataFrame:
    """Every key in every period; the periods are a calendar. Spark broadcasts the smaller side where its size allows."""
    return keys.crossJoin(periods)
