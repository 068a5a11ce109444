"""Sparse daily series against the same on every day."""

import datetime
import random

from pyspark.sql import functions as F

from tessera.operators import resolve, sparse

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)


def series(seed=1, keys=40, days=60):
    r = random.Random(seed)
    out = {}
    for k in range(keys):
        out[k] = {r.randint(0, days - 1): r.randint(1, 9) for _ in range(r.choice((1, 2, 5, 30)))}
    out[keys] = {n: 1 for n in range(days)}  # every day
    out[keys + 1] = {0: 3, days - 1: 4}
    return out, days


def frame(spark, s):
    return spark.createDataFrame([(k, DAY(n), v) for k, own in s.items() for n, v in own.items()], "k int, day date, n long")


def test_gaps(spark):
    s, days = series()
    df = frame(spark, s)
    for least in (1, 2, 5):
        want = set()
        for k, own in s.items():
            start = None
            for n in range(days + 1):
                zero = n < days and n not in own
                if zero and start is None:
                    start = n
                if not zero and start is not None:
                    if n - start >= least:
                        want.add((k, DAY(start), DAY(n - 1), n - start))
                    start = None
        assert {tuple(r) for r in sparse.gaps(df, ["k"], sparse.calendar(df), least).collect()} == want
    assert sparse.gaps(df.limit(0), ["k"], sparse.calendar(df.limit(0))).count() == 0


def test_sums_before(spark):
    s, days = series(2)
    df = frame(spark, s)
    got = {(r["k"], r["day"]): (r["n"], r["b"], r["_age"]) for r in sparse.touched(df, ["k"], "n", sparse.calendar(df), 3).withColumn("b", sparse.before("n", ["k"], 3)).collect()}
    for k, own in s.items():
        for n in range(days):
            full = (own.get(n, 0), sum(own.get(n - j, 0) for j in (1, 2, 3)), n)
            if full[:2] == (0, 0):
                assert (k, DAY(n)) not in got or got[k, DAY(n)] == full
            else:
                assert got[k, DAY(n)] == full
    assert len(got) <= 4 * sum(map(len, s.values()))


def test_matches_equal_the_dense_ones(spark):
    s, days = series(3)
    df = frame(spark, s)
    of = lambda x: x.select("k", F.datediff("day", F.lit("2024-01-01")).cast("long").alias("period"))
    busy = df.where("n >= 5")
    zeros = spark.createDataFrame([(k, DAY(n)) for k, own in s.items() for n in range(days) if n not in own], "k int, day date")
    run = lambda idle: sorted(map(str, resolve.greedy_match(of(busy), of(idle), ["k"], 2).collect()))
    assert run(sparse.near_zeros(df, busy, ["k"], sparse.calendar(df), 2)) == run(zeros)
