"""Detectors and repairs: duplicates, relists, spikes, cliffs, expectations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import trailing


def duplicate_share(df: DataFrame, content: Sequence[str], by: str) -> DataFrame:
    """Rows of each day, extra copies of equal content, and their share."""
    counts = df.groupBy(*content).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("extra")).withColumn("extra_share", F.col("extra") / F.col("n_rows"))


def dedupe_where(df: DataFrame, flagged: DataFrame, on: str, content: Sequence[str], keep: str) -> DataFrame:
    """On flagged values of on, one row of each content stays, that with the smallest keep; other rows all stay and are
    not shuffled by content."""
    flagged = flagged.select(on).distinct()
    n = F.row_number().over(W.partitionBy(*content).orderBy(keep))
    kept = df.join(flagged, on, "left_semi").withColumn("_n", n).where("_n = 1").drop("_n")
    return df.join(flagged, on, "left_anti").unionByName(kept)


def relist_collapse(df: DataFrame, by: Sequence[str], day: str, gap: int) -> DataFrame:
    """Kept dates of each group: a date stays if it is more than gap days after the last kept one. One fold over the
    group's sorted distinct dates, which a calendar bounds."""
    dates = F.sort_array(F.collect_set(day))
    empty = F.array().cast("array<date>")
    fold = F.aggregate(dates, empty, lambda kept, d: F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) > gap), F.concat(kept, F.array(d))).otherwise(kept))
    return df.groupBy(*by).agg(F.count("*").alias("n_raw"), fold.alias("_kept")).select(*by, "n_raw", F.explode("_kept").alias("kept_day"))


def winsorized(value: str, flag: Column, by: Sequence[str], order: Sequence[str], rows: int = 6) -> Column:
    """Flagged values become the median of up to so many raw values before them; without any they stay."""
    return F.when(flag, F.coalesce(trailing(F.percentile(value, 0.5), by, order, rows), F.col(value))).otherwise(F.col(value))


def cliff(value: str, by: Sequence[str], order: Sequence[str], rows: int = 4, drop: float = 0.5) -> Column:
    """Whether a value lies more than drop below the mean of the periods before; false without history."""
    mean = trailing(F.avg(value), by, order, rows)
    return F.coalesce((mean > 0) & (F.col(value) < (1 - drop) * mean), F.lit(False))


# --- expectations: rows that violate, as (name, n)


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")


def unique(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return _n(df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1"), name)


def not_null(df: DataFrame, column: str, name: str) -> DataFrame:
    return _n(df.where(F.col(column).isNull()), name)


def accepted(df: DataFrame, column: str, values: Sequence, name: str) -> DataFrame:
    return _n(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)), name)


def relationship(df: DataFrame, column: str, other: DataFrame, key: str, name: str) -> DataFrame:
    return _n(df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti"), name)


def violations(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return _n(df.where(condition), name)


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("passed", F.col("n_violations") == 0)


# --- joins


def clean_keys(frames: Sequence[DataFrame], key: str) -> list[DataFrame]:
    """The frames with their key trimmed and in upper case."""
    return [f.withColumn(key, F.upper(F.trim(key))) for f in frames]


def join_loss(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows on the left, rows that an inner join to the distinct keys of the right keeps, and rows that it loses."""
    j = left.join(right.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return j.agg(F.count("*").alias("n_left"), F.count("_hit").alias("n_joined")).withColumn("n_lost", F.col("n_left") - F.col("n_joined"))
