"""Set-overlap joins against all pairs, with a member that is in thousands of sets."""

import random

import pytest

from tessera.operators import signals


def plain(left, right, share, fits):
    out = {}
    for r, members in right.items():
        for x, own in left.items():
            n = len(members & own)
            if n > share * len(members) and fits(x, r):
                out[x, r] = (n, len(members))
    return out


def frames(spark, left, right, values):
    a = [(x, m, values.get(x)) for x, ms in left.items() for m in ms]
    b = [(x, m, values.get(x)) for x, ms in right.items() for m in ms]
    return spark.createDataFrame(a, "left string, member long, a double"), spark.createDataFrame(b, "right string, member long, b double")


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8])
def test_overlap_equals_all_pairs(spark, share):
    r = random.Random(5)
    left = {f"l{n}": {int(40 * r.random() ** 2) for _ in range(r.randint(1, 25))} for n in range(60)}
    right = {f"r{n}": {int(40 * r.random() ** 2) for _ in range(r.randint(1, 25))} for n in range(60)}
    values = {k: r.choice([0.0, -1.0, 1.0, r.uniform(0.1, 9.0), None]) for k in [*left, *right]}
    a, b = frames(spark, left, right, values)
    got = {(x["left"], x["right"]): (x["n"], x["people"]) for x in signals.overlapping(a, b, share).collect()}
    assert got == plain(left, right, share, lambda x, y: True) and got
    got = {(x["left"], x["right"]): (x["n"], x["people"]) for x in signals.overlapping(a, b, share, [("a", "b", 0.8, 1.25)]).collect()}
    near = lambda x, y: (values[x] or 0) > 0 and (values[y] or 0) > 0 and 0.8 <= values[y] / values[x] <= 1.25
    assert got == plain(left, right, share, near) and got


def test_a_member_of_ten_thousand_sets(spark):
    """One panelist buys under 10,000 known and 10,000 new names, each with two panelists of its own: 10**8 pairs share the
    hot one, and only the 10,000 right ones are found."""
    n = 10_000
    left = spark.range(n).selectExpr("concat('l', id) AS left", "explode(array(-1L, 2 * id, 2 * id + 1)) AS member", "1.0D AS a")
    right = spark.range(n).selectExpr("concat('r', id) AS right", "explode(array(-1L, 2 * id, 2 * id + 1)) AS member", "1.0D AS b")
    got = signals.overlapping(left, right, 0.5, [("a", "b", 0.8, 1.25)]).collect()
    assert len(got) == n and all(x["left"][1:] == x["right"][1:] and x["n"] == x["people"] == 3 for x in got)


def _feed(spark, n=3000):
    """A feed over 2022 to 2023 in which names are renamed at different times."""
    import datetime

    r = random.Random(9)
    rows = []
    for k in range(n):
        day = datetime.date(2022, 1, 1) + datetime.timedelta(days=r.randint(0, 729))
        name, panelist = f"n{k % 12}", r.randint(0, 30) + 40 * (k % 12)
        if k % 12 < 4 and day >= datetime.date(2022, 7 + k % 12, 1) and r.random() < 0.9:
            name += " x"
        rows.append((name, day, float(10 + k % 12 * 30 + r.randint(0, 3)), panelist))
    rows += [(None, rows[0][1], 1.0, 1), ("n1", rows[0][1], 1.0, None)]
    feed = spark.createDataFrame(rows, "descriptor string, day date, amount double, panelist long")
    return feed, spark.createDataFrame([(f"n{k}", f"v{k}") for k in range(12)], "descriptor string, vendor string")


def test_no_horizon_sees_the_future(spark):
    from pyspark.sql import functions as F

    from tessera.operators import vendors

    feed, known = _feed(spark)
    key = lambda df: {(x["vendor"], x["quarter"]): tuple(x) for x in df.collect()}
    full = key(vendors.spend_features(feed, known, 8))
    naive = key(vendors.spend_features(feed, known, 8, qa=False))
    assert any(full[k] != naive[k] for k in naive)  # renamed names are bridged at some horizon
    for q in (3, 5):
        seen = feed.where(F.add_months(F.trunc("day", "MM"), 1) <= F.last_day(F.add_months(F.lit("2022-01-01").cast("date"), 3 * q + 2)))
        assert {k: v for k, v in key(vendors.spend_features(seen, known, q + 1)).items()} == {k: v for k, v in full.items() if k[1] <= q}
    assert vendors.spend_features(feed.limit(0), known, 8).count() == 0


def test_horizons_equal_runs_by_horizon(spark):
    from pyspark.sql import functions as F

    from tessera.operators import vendors

    feed, known = _feed(spark)
    feed = feed.withColumn("since", vendors.quarter_of(F.add_months(F.trunc("day", "MM"), 1)))
    got = signals.bridges(feed, known, 7).collect()
    assert len({x["horizon"] for x in got}) > 1
    for q in range(8):
        want = signals.bridge(feed.where(F.col("since") <= q).drop("since"), known).collect()
        assert sorted(tuple(x)[1:] for x in got if x["horizon"] == q) == sorted(map(tuple, want))


def test_quantiles_by_horizon(spark):
    import statistics

    from tessera.operators import order

    r = random.Random(4)
    rows = [(r.choice("ab"), float(r.randint(0, 40)), r.randint(0, 5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, since int")
    got = {(x["g"], x["horizon"]): x["mid"] for x in order.quantiles(df, ["g"], "v", {"mid": 0.5}, "since", 3).collect()}
    assert got == {(g, h): statistics.median([v for x, v, s in rows if x == g and s <= h]) for g in "ab" for h in range(4)}
