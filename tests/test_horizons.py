"""Horizons of a large feed: what is stored of it, and order statistics only where they are asked."""

import os
import random
import statistics

from pyspark.sql import functions as F

from tessera.operators import order, vendors


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_a_feed_is_stored_once_and_narrow(spark):
    """Three names of twelve are renamed for nine tenths of their rows; all amounts differ. A row of the feed is
    kept in some 12 bytes, of which its random amount takes 8 (23 when it was checkpointed, then its amounts again)."""
    n = 200_000
    day = F.date_add(F.lit("2022-01-01").cast("date"), (F.xxhash64("id") % 365 + 365).cast("int"))
    x = spark.range(n).select("id", F.concat(F.lit("name "), F.col("id") % 12).alias("own"), day.alias("day"))
    new = (F.col("id") % 12 < 3) & (F.col("day") >= "2022-10-01") & (F.col("id") % 120 >= 12)
    feed = x.select(F.when(new, F.concat("own", F.lit(" x"))).otherwise(F.col("own")).alias("descriptor"), "day", (100 * (F.col("id") % 12 + 1) + F.rand(1)).alias("amount"), (F.col("id") % 12 * 50 + F.col("id") % 49).alias("panelist"))
    known = x.select(F.col("own").alias("descriptor"), F.col("own").alias("vendor")).distinct()
    folder = spark.conf.get("spark.checkpoint.dir")
    before = size(folder)
    got = {(r["vendor"], r["quarter"]): r["spend_count"] for r in vendors.spend_features(feed, known, 8).collect()}
    assert size(folder) - before < 17 * n
    plain = {(r["vendor"], r["quarter"]): r["spend_count"] for r in vendors.spend_features(feed, known, 8, qa=False).collect()}
    assert {v for v, q in got if got[v, q] > 3 * plain[v, q] > 0} == {"name 0", "name 1", "name 2"}


def test_quantiles_at_asked_horizons(spark):
    r = random.Random(6)
    kinds = [lambda: 1000 + r.random() / 1e6, lambda: -float(r.randint(0, 400)), lambda: r.uniform(-1e-3, 1e-3), lambda: 10 ** r.uniform(-9, 12), lambda: 7.0, lambda: float(r.randint(0, 3))]
    rows = [(None if g == 5 else f"g{g}", kinds[g](), r.randint(-1, 6)) for _ in range(500) for g in range(6)]
    asked = [(g, h) for g in (None, "g0", "g1", "g2", "g3", "g4", "none") for h in range(5) if r.random() < 0.6]
    df, at = spark.createDataFrame(rows, "g string, v double, since int"), spark.createDataFrame(asked, "g string, horizon int")
    got = {(x["g"], x["horizon"]): x["mid"] for x in order.quantiles(df, ["g"], "v", {"mid": 0.5}, "since", 5, at).collect()}
    assert got == {(g, h): statistics.median([v for x, v, s in rows if x == g and s <= h]) for g, h in asked if g != "none"} and len(got) > 9
