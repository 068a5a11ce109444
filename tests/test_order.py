"""Exact order statistics of large groups against plain Python."""

import random
import statistics

import numpy as np
import pytest

from tessera.operators import order


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(g, r.choice([None, 1.0, 2.0, float(r.randint(0, 50_000)), r.random()]), r.randint(0, 5)) for g in [None, "a", "b"] for _ in range(3000)]
    out += [("hot", 7.0, 1)] * 6000 + [("hot", float(v), 1) for v in range(40)] + [("one", 3.0, 2), ("none", None, 1), ("zero", 5.0, 0), ("zero", 4.0, 0)]
    r.shuffle(out)
    return out


def present(rows, g):
    return sorted((v, w) for x, v, w in rows if x == g and v is not None)


def test_weighted_median(spark, rows):
    want = {}
    for g in {x for x, v, _ in rows if v is not None}:
        own, run = present(rows, g), 0
        total = sum(w for _, w in own)
        for v in sorted({v for v, _ in own}):
            run += sum(w for x, w in own if x == v)
            if 2 * run >= total:
                want[g] = v
                break
    df = spark.createDataFrame(rows, "g string, v double, w long")
    assert {x["g"]: x["weighted_median"] for x in order.weighted_median(df, "v", "w", ["g"]).collect()} == want
    assert order.weighted_median(df.limit(0), "v", "w", ["g"]).count() == 0


def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(9)
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "high": 1.0}
    got = {x["g"]: x for x in order.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {x for x, v, _ in rows if v is not None}
    for g, x in got.items():
        own = [v for v, _ in present(rows, g)]
        assert x["mid"] == pytest.approx(statistics.median(own))
        for name, share in shares.items():
            assert x[name] == pytest.approx(np.quantile(own, share)), (g, name)
    whole = order.quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert [x["mid"] for x in whole] == [pytest.approx(statistics.median([v for _, v, _ in rows if v is not None]))]
    assert order.quantiles(df.limit(0), ["g"], "v", shares).count() == 0 and order.quantiles(df.where("g = 'none'"), ["g"], "v", shares).count() == 0


def test_average_ranks(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = order.average_ranks(df, ["g"], "v", "r").collect()
    assert len(got) == sum(v is not None for _, v, _ in rows)
    for g in (None, "a", "hot"):
        own = np.array([v for v, _ in present(rows, g)])
        for x in [x for x in got if x["g"] == g][:200]:
            assert x["r"] == (own < x["v"]).sum() + ((own == x["v"]).sum() + 1) / 2


def test_a_group_is_split_over_tasks(spark):
    """The one group of a table falls into about as many stretches as there are partitions, of about equal weight."""
    df = spark.range(80_000).selectExpr("0 AS g", "id * 7919 % 80021 AS v", "1L AS w")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        _, sums = order.stretches(df, ["g"], "v", "w")
        held = sorted(x["_held"] for x in sums.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) == 8 and held[-1] < 80_000 * 0.3 and sum(held) == 80_000
