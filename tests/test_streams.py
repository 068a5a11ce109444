"""Relistings as an endless stream: order, lateness and the size of state."""

import datetime
import random

import pytest

from tessera.streaming import monitors

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)


@pytest.fixture
def store(spark):
    spark.conf.set(*monitors.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(monitors.STORE[0])
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, tmp_path, batches, name, **settings):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, d date").coalesce(1).write.parquet(str(tmp_path / "made" / str(n)))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, d date").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = monitors.settled_listings(stream, "k", "d", **settings).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    sizes = []
    try:
        for n in range(len(batches)):
            part = next((tmp_path / "made" / str(n)).glob("part-*.parquet"))
            part.rename(tmp_path / "in" / f"{n:03}.parquet")
            q.processAllAvailable()
            sizes.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))
    finally:
        q.stop()
    return sorted((r["k"], r["kept_day"]) for r in spark.table(name).collect()), sizes


def plain(days, gap):
    kept = []
    for d in sorted(set(days)):
        if not kept or d - kept[-1] > gap:
            kept.append(d)
    return kept


def test_any_order_within_the_horizon(spark, store, tmp_path):
    r = random.Random(2)
    days = {k: [r.randint(0, 70) for _ in range(12)] for k in "abc"}
    rows = sorted(((d + r.randint(0, 4), k, d) for k, own in days.items() for d in own), key=lambda x: x[0])  # they come up to four days late
    batches = [[(k, DAY(d)) for at, k, d in rows if lo <= at < lo + 25] or [("a", None)] for lo in range(0, 75, 25)]
    got, _ = run(spark, tmp_path, [*batches, [("end", DAY(200)), (None, DAY(199))]], "settled", gap=10, late=30)
    assert [(k, d) for k, d in got if k in days] == sorted((k, DAY(d)) for k, own in days.items() for d in plain(own, 10))


def test_late_days_are_ignored_and_state_is_bounded(spark, store, tmp_path):
    """New keys every ten days for 200 days: state holds those of the last gap + late days. A day behind the watermark counts for nothing."""
    batches = [[(f"k{n}-{i}", DAY(10 * n)) for i in range(20)] for n in range(20)]
    batches[10].append(("k0-0", DAY(3)))  # late by months
    got, sizes = run(spark, tmp_path, batches, "bounded", gap=20, late=10)
    assert ("k0-0", DAY(0)) in got and ("k0-0", DAY(3)) not in got
    assert len(got) >= 20 * 18 and len(got) == len(set(got))
    assert max(sizes[10:]) <= max(sizes[:8]) and sizes[-1] < 20 * 20 * 3
