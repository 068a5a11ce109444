"""Exact order statistics of groups of any size: running sums, quantiles, weighted medians, average ranks.

Two passes. The first range-partitions (group, value), so that a partition holds a stretch of a group's values and equal
values meet, and adds up weights by group and partition; prefix sums over these few rows say which stretch holds a wanted
place. The second looks at those stretches only. No group lands in one task, and no value is compared with a list of cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import durable, looked_up

_PART = "_part"
#: Cells of a logarithmic scale per factor e, in which values are counted before any of them is looked at.
CELLS = 128


def _joined(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with the other columns of small, a row a key; a null key is a key."""
    other = small.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in small.columns))
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return df.join(other, same).drop(*(f"_on_{c}" for c in on))


def stretches(df: DataFrame, by: Sequence[str], value: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sums): df (a row a group and value) in stretches of each group's order, and by group and stretch the weight
    before it (_base), in it (_held) and of the group (_all)."""
    rows = durable(df.repartitionByRange(*by, value).withColumn(_PART, F.spark_partition_id()))
    sums = rows.groupBy(*by, _PART).agg(F.sum(weight).alias("_held"))
    along = W.partitionBy(*by).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    base = F.coalesce(F.sum("_held").over(along), F.lit(0))
    return rows, sums.select(*by, _PART, "_held", base.alias("_base"), F.sum("_held").over(W.partitionBy(*by)).alias("_all"))


def _inside(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> Column:
    """The weight of smaller values of the same stretch."""
    along = W.partitionBy(*by, _PART).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(along), F.lit(0))


def sums_before(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """df (a row a group and value) with before, the weight of smaller values, and all, the weight of the group. Null groups are
    groups; a null value is the smallest."""
    rows, sums = stretches(df, by, value, weight)
    x = _joined(rows.withColumn("before", _inside(rows, by, value, weight)), sums.drop("_held"), [*by, _PART])
    return x.withColumn("before", F.col("_base") + F.col("before")).withColumnRenamed("_all", "all").drop("_base", _PART)


def weighted_median(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """The smallest value at which half of a group's weight is reached. Weights of equal values are summed first; null values
    and weights count for nothing, a group without others has none."""
    present = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    rows, sums = stretches(present.groupBy(*by, value).agg(F.sum(weight).alias("_w")), by, value, "_w")
    half = sums.where((F.col("_base") + F.col("_held")) * 2 >= F.col("_all")).groupBy(*by).agg(F.min_by(F.struct(_PART, "_base", "_all"), _PART).alias("_x")).select(*by, f"_x.{_PART}", "_x._base", "_x._all")
    x = _joined(rows, half, [*by, _PART])
    x = x.withColumn("_before", F.col("_base") + _inside(x, by, value, "_w")).where((F.col("_before") + F.col("_w")) * 2 >= F.col("_all"))
    return x.groupBy(*by).agg(F.min(value).alias("weighted_median"))


def _cells(value: Column) -> Column:
    """Cells that rise with the value, whatever its size or sign; NaN is the last one."""
    v = value.cast("double")
    return F.rint(F.signum(v) * F.log1p(F.abs(v)) * CELLS) + 0.0


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], since: str | None = None, last: int = 0, at: DataFrame | None = None) -> DataFrame:
    """A row a group with a column for each named share (0.5: the median), as doubles, linear between neighbouring values. Null
    values count for nothing; a group without others has no row. by may be empty.

    With since, a column of whole numbers, there is a row for each group and horizon up to last, over the rows whose since is not
    above it: a row enters once and never leaves. at (by, horizon; distinct) names the horizons that are asked, by group.

    Rows are neither copied for the horizons nor shuffled: they are counted by cell and since, and only rows of cells that hold a
    wanted place are looked at, in stretches. df is read twice.
    """
    every = [*by] or ["_every"]
    present = df.where(F.col(value).isNotNull()).withColumn("_since", F.lit(0) if since is None else F.col(since).cast("int"))
    if not by:
        present = present.withColumn("_every", F.lit(0))
    present = present.where(F.col("_since") <= last).select(*every, value, "_since", _cells(F.col(value)).alias("_cell"))
    group = W.partitionBy(*every, "_horizon")

    def onward(x: DataFrame, keys: Sequence[str], asked: DataFrame | None) -> DataFrame:
        """Rows of x by keys and horizon, all that have entered by then."""
        if asked is None:
            x = x.withColumn("_horizon", F.explode(F.sequence(F.greatest("_since", F.lit(0)), F.lit(last))))
        else:
            x = _joined(x, asked, [c for c in keys if c in asked.columns]).where(F.col("_since") <= F.col("_horizon"))
        return x.groupBy(*keys, "_horizon").agg(F.sum("_n").alias("_held"))

    def before(over: W, order: str) -> Column:
        return F.coalesce(F.sum("_held").over(over.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    entered = present.groupBy(*every, "_cell", "_since").agg(F.count("*").alias("_n"))
    sums = onward(entered, [*every, "_cell"], None if at is None else at.select(*by, F.col("horizon").alias("_horizon"), *([] if by else [F.lit(0).alias("_every")])))
    sums = sums.select(*every, "_cell", "_horizon", "_held", before(group, "_cell").alias("_base"), F.sum("_held").over(group).alias("_all"))
    wanted = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        wanted += [F.struct(F.lit(name).alias("_name"), F.lit(k).alias("_end"), f(place).cast("long").alias("_place"), (place - F.floor(place)).alias("_share")) for k, f in enumerate((F.floor, F.ceil))]
    inside = (F.col("_place") >= F.col("_base")) & (F.col("_place") < F.col("_base") + F.col("_held"))
    want = sums.select(*every, "_cell", "_horizon", "_base", "_held", F.inline(F.array(*wanted))).where(inside)
    want = durable(want.select(*every, "_cell", "_horizon", "_name", "_end", (F.col("_place") - F.col("_base")).alias("_place"), "_share"))

    cell = [*every, "_cell"]
    held = _joined(present, looked_up(want.select(*cell).distinct()), cell)
    counted = held.groupBy(*cell, value, "_since").agg(F.count("*").alias("_n"))
    rows = durable(counted.repartitionByRange(*every, value).withColumn(_PART, F.spark_partition_id()))
    sums = onward(rows.groupBy(*cell, _PART, "_since").agg(F.sum("_n").alias("_n")), [*cell, _PART], want.select(*cell, "_horizon").distinct())
    sums = sums.withColumn("_base", before(W.partitionBy(*cell, "_horizon"), _PART))
    want = _joined(sums, want, [*cell, "_horizon"]).where(inside)
    # the places of a stretch as one row, so that the stretch is read once whatever is asked of it
    asked = want.groupBy(*cell, _PART, "_horizon", "_base").agg(F.collect_list(F.struct("_name", "_end", "_place", "_share")).alias("_asked"))
    x = _joined(rows, asked, [*cell, _PART]).where(F.col("_since") <= F.col("_horizon"))
    along = W.partitionBy(*cell, _PART, "_horizon").orderBy(value, "_since").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(along), F.lit(0)))
    hit = F.filter("_asked", lambda a: (a["_place"] >= F.col("_before")) & (a["_place"] < F.col("_before") + F.col("_n")))
    x = x.select(*every, "_horizon", F.col(value).cast("double").alias("_v"), F.inline(hit))
    low, high = F.max(F.when(F.col("_end") == 0, F.col("_v"))), F.max(F.when(F.col("_end") == 1, F.col("_v")))
    each = x.groupBy(*every, "_horizon", "_name").agg(((1 - F.max("_share")) * low + F.max("_share") * high).alias("_q"))
    keys = [*by] if since is None else [*by, F.col("_horizon").alias("horizon")]
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in shares))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value in its group, for groups too large for one window; rows without a value go."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    r = sums_before(n, by, value, "_n").select(*by, value, (F.col("before") + (F.col("_n") + 1) / 2).alias(name))
    return _joined(df.where(F.col(value).isNotNull()), r, [*by, value])
