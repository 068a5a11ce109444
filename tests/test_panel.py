"""The estimator ladder against plain computations on a small panel, raking, collapse, feeds and checks that end a run."""

import datetime

import numpy as np
import pandas as pd
import pytest

from tessera.operators import estimators, feeds, panel, quality


def plain_ipf(t, rows, columns):
    t = t.astype(float)
    for _ in range(500):
        t = t * np.where(t.sum(1) > 0, rows / np.maximum(t.sum(1), 1e-300), 0)[:, None]
        t = t * np.where(t.sum(0) > 0, columns / np.maximum(t.sum(0), 1e-300), 0)[None]
    return t


def test_raking_meets_margins():
    r = np.random.default_rng(1)
    t = r.integers(1, 50, (12, 4)).astype(float)
    rows, columns = r.uniform(10, 50, 12), r.uniform(1, 9, 4)
    out = t * panel.raking_factors(t, rows, columns)
    columns = columns * rows.sum() / columns.sum()
    assert np.allclose(out.sum(1), rows, rtol=1e-6) and np.allclose(out.sum(0), columns, rtol=1e-6) and np.allclose(out, plain_ipf(t, rows, columns), rtol=1e-5)
    t[3] = 0  # an empty row stays empty
    assert (panel.raking_factors(t, rows, columns)[3] == 0).all()


def test_small_cells_join_their_neighbours():
    full = np.full((4, 3), 20)
    assert len(np.unique(panel.collapsed(full))) == 12
    one = full.copy()
    one[0, 1] = 2  # joins the next age of the same income
    g = panel.collapsed(one)
    assert g[0, 1] == g[1, 1] and len(np.unique(g)) == 11
    two = full.copy()
    two[2:, 0], two[2:, 1] = 1, 2  # both ages together are too few in two incomes: all four join
    g = panel.collapsed(two)
    assert len({g[2, 0], g[3, 0], g[2, 1], g[3, 1]}) == 1 and len(np.unique(g)) == 9
    two[2:, 1] = 3  # six together: the middle income stands alone
    g = panel.collapsed(two)
    assert g[2, 0] == g[3, 0] != g[2, 1] == g[3, 1]


def test_weights_are_cut_once():
    n = np.full((4, 3, 4), 10.0)
    goal = np.full((4, 3), 100.0)
    goal[0, 0] = 9000.0  # far above five times the median
    w = panel.cell_weights(n, goal, np.full(4, 250.0))
    assert np.allclose((n * w).sum(2), goal, rtol=1e-6)
    assert w.max() > panel.CAP * np.median(w)  # the second raking may exceed the cap again
    n[0, 0] = 0
    assert (panel.cell_weights(n, goal, np.full(4, 250.0))[0, 0] == 0).all()


def small(spark, spells=()):
    """Two panelists and one who leaves, one subscription and one shop, twelve months."""
    day = lambda m: datetime.date(2022 + (m - 1) // 12, (m - 1) % 12 + 1, 5)
    rows = [(p, c, m, day(m), i, a) for p, c, months, i, a in [
        (1, "sub", (1, 2, 3, 5, 6, 9, 10, 11, 12), "x", 10.0), (2, "sub", (4, 5, 6, 7), "x", 20.0), (3, "sub", (1, 2, 3), "y", 30.0), (1, "shop", (2, 7), "y", 5.0), (2, "shop", (11,), "x", 7.0), (2, None, (1, 9), "x", 1.0),
    ] for m in months]
    txns = spark.createDataFrame(rows, "panelist long, company string, month int, day date, instrument string, amount double")
    who = spark.createDataFrame([(1, 0, 0, "N", 1, 0), (2, 0, 1, "N", 1, 0), (3, 1, 0, "S", 1, 4)], "panelist long, age int, income int, region string, joined int, left int")
    margins = spark.createDataFrame([("age_income", a, i, None, 50.0) for a in (0, 1) for i in (0, 1)] + [("region", None, None, "N", 120.0), ("region", None, None, "S", 80.0)], "margin string, age int, income int, region string, population double")
    companies = spark.createDataFrame([("sub", True), ("shop", False)], "company string, subscription boolean")
    reported = spark.createDataFrame([("sub", 0, 100.0, 3.0), ("sub", 1, None, None), ("shop", 0, 10.0, 2.0)], "company string, quarter int, revenue double, actives double")
    return estimators.Panel(txns, who, companies, margins, reported, 12)


def test_indicators_of_a_small_panel(spark):
    p = small(spark)

    def of(spells):
        rows = estimators.indicators(p, p.txns, spells).collect()
        return {(r["panelist"], r["company"], r["quarter"]): (r["rev"], r["act"], r["add"], r["num"], r["den"]) for r in rows}

    naive, spells = of(False), of(True)
    assert naive[1, "sub", 0] == (30.0, 1, 0, 0, 0) and naive[1, "sub", 1][:2] == (20.0, 1)
    assert naive[2, "sub", 1] == (60.0, 1, 1, 0, 0)  # first seen in month 4
    assert naive[2, "sub", 2] == (20.0, 0, 0, 1, 1)  # not charged in month 9
    assert naive[3, "sub", 1] == (0.0, 0, 0, 0, 0)  # left: not a loss
    assert spells[1, "sub", 2] == (10.0, 1, 1, 0, 1)  # months 7 and 8 are two: a spell ends in 6, another starts in 9
    assert spells[1, "sub", 1][3] == 1 and spells[1, "sub", 0][3] == 0  # month 4 is bridged
    assert spells[3, "sub", 0][3] == 0 and spells[2, "sub", 2][3] == 1
    assert [naive.get((1, "shop", q), (0, 0))[1] for q in range(4)] == [1, 1, 1, 1] and naive[2, "shop", 3] == (7.0, 1, 1, 0, 0)


def test_ladder_and_its_call(spark):
    p = small(spark)
    m1 = {(r["company"], r["quarter"], r["kpi"]): r["estimate"] for r in estimators.estimate("m1", p).collect()}
    assert len(m1) == 2 * 4 * 6
    scale = 200.0 / 3
    assert m1["sub", 0, "revenue"] == pytest.approx(120 * scale) and m1["sub", 0, "market_share"] == pytest.approx(100 * 120 / 125)
    assert m1["shop", 0, "arpu"] == pytest.approx(5.0) and m1["sub", 2, "churn_rate"] == pytest.approx(0.5)
    m2 = {(r["company"], r["kpi"]): r["estimate"] for r in estimators.estimate("m2", p, 0).collect()}
    assert m2["sub", "revenue"] > 0 and len(m2) == 12
    m3 = {(r["company"], r["quarter"]): r for r in estimators.wide("m3", p).collect()}
    m4 = {(r["company"], r["quarter"]): r for r in estimators.wide("m4", p).collect()}
    f = 100.0 / m3["sub", 0]["revenue"]
    assert m4["sub", 0]["revenue"] == m3["sub", 0]["revenue"]  # nothing earlier
    assert m4["sub", 2]["revenue"] == pytest.approx(m3["sub", 2]["revenue"] * f) and m4["sub", 3]["churn_rate"] == m3["sub", 3]["churn_rate"]
    with pytest.raises(ValueError):
        estimators.estimate("m5", p)


def test_bootstrap_draws_and_intervals(spark):
    for size in (1, 2, 63, 64, 65, 2000):
        n = estimators.draws(np.arange(size), size, 50, 7)
        assert (n.sum(0) == size).all() and (n >= 0).all()  # multinomial: every replicate is a whole panel
        some = np.array(sorted({0, size // 3, size - 1}))
        assert (estimators.draws(some, size, 50, 7) == n[some]).all()  # whatever part of the panel a task holds
    assert abs(n.var() - 1) < 0.03 and (n != estimators.draws(np.arange(2000), 2000, 50, 8)).any()
    p = small(spark)
    many = spark.range(60).select((estimators.F.col("id") * 10).alias("k"))
    p.txns = p.txns.crossJoin(many).withColumn("panelist", estimators.F.col("panelist") + estimators.F.col("k")).drop("k")
    p.panelists = p.panelists.crossJoin(many).withColumn("panelist", estimators.F.col("panelist") + estimators.F.col("k")).drop("k")
    ci = {(r["method"], r["company"], r["quarter"], r["kpi"]): (r["ci_low"], r["ci_high"]) for r in estimators.bootstrap(p, replicates=40).collect()}
    for m in estimators.METHODS:
        for r in estimators.wide(m, p).collect():
            low, high = ci[m, r["company"], r["quarter"], "revenue"]
            assert low <= r["revenue"] * 1.001 and high >= r["revenue"] * 0.999 and (r["revenue"] == 0 or high < 2 * r["revenue"])


def test_replicates_add_up_to_the_panel(spark):
    """Whatever the partitions, in every of 400 replicates the draws of all panelists sum to their number."""
    who = spark.range(700).selectExpr("id * 31 AS panelist", "id % 3 AS g", "1.0D AS n")
    panel = estimators.placed(who.union(who))
    assert panel[1] == 700 and sorted(r["place"] for r in panel[0].collect()) == list(range(700))
    got = []
    for parts in (1, 7):
        sums = estimators._replicate_sums(who.repartition(parts), ["g"], ["n"], panel, 400, 7)
        assert [r[0] for r in sums.groupBy("b").agg(estimators.F.sum("n")).select("sum(n)").distinct().collect()] == [700.0] and sums.select("b").distinct().count() == 400
        got.append(sorted(map(tuple, sums.collect())))
    assert got[0] == got[1]


def test_validated_join_and_scorecard(spark):
    e = spark.createDataFrame([("m1", "a", 0, "revenue", 110.0, 90.0, 120.0, True), ("m1", "a", 1, "revenue", 80.0, 90.0, 95.0, True), ("m1", "a", 2, "revenue", 1.0, 0.0, 1.0, False)], "method string, company string, quarter int, kpi string, estimate double, ci_low double, ci_high double, scored boolean")
    t = spark.createDataFrame([("a", 0, "revenue", 100.0), ("a", 1, "revenue", 100.0)], "company string, quarter int, kpi string, truth double")
    r = estimators.scorecard(e, t, [1]).first()
    assert (r["n"], r["mape"], r["median_ape"], r["coverage"], r["pathology_cost"]) == (2, pytest.approx(15.0), pytest.approx(15.0), 0.5, pytest.approx(10.0))
    with pytest.raises(Exception, match="not unique"):
        estimators.scorecard(e, t.union(t)).collect()
    with pytest.raises(Exception, match="no truth"):
        estimators.scorecard(e, t.limit(0)).collect()


def test_hard_checks_end_the_run(spark):
    ok = quality.report([quality.violations(spark.range(3), estimators.F.col("id") < 0, "fine")])
    assert feeds.enforce(ok).count() == 1
    bad = quality.report([quality.violations(spark.range(3), estimators.F.col("id") > 0, "too_large")])
    with pytest.raises(ValueError, match=r"too_large \(2\)"):
        feeds.enforce(ok.unionByName(bad))


def test_doubled_days_are_repaired(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = [(100 * n + k, k, day(n), float(k)) for n in range(10) for k in range(8 + n % 2)] + [(5000 + k, k, day(9), float(k)) for k in range(9)] + [(9999, 0, day(3), 0.0)]
    df = spark.createDataFrame(rows, "txn_id long, panelist long, day date, amount double")
    d = {r["day"]: r for r in feeds.doubled_days(df, ["panelist", "day", "amount"], "day").collect()}
    assert [n for n in range(10) if d[day(n)]["doubled"]] == [9] and d[day(9)]["volume_z"] > 10 and d[day(3)]["extra"] == 1 and d[day(1)]["volume_z"] == float("inf")
    fixed = quality.dedupe_where(df, spark.createDataFrame([(day(9),)], "day date"), "day", ["panelist", "day", "amount"], "txn_id")
    assert fixed.where(fixed["day"] == day(9)).count() == 9 and fixed.where("txn_id = 9999").count() == 1 and fixed.where("txn_id >= 5000").count() == 1


def test_outage_needs_history_and_three_days(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = [("a", day(n)) for n in range(20) for _ in range(40) if n not in (10, 11, 12, 15, 16)] + [("b", day(n)) for n in range(20)] + [("c", day(n)) for n in range(20) for _ in range(40) if n not in (2, 3, 4)]
    got = [tuple(r) for r in feeds.outages(spark.createDataFrame(rows, "instrument string, day date"), "instrument", "day").collect()]
    assert got == [("a", day(10), day(12), 3)]
    assert pd.DataFrame(got).shape == (1, 4)
