"""Streaming monitors, regression drivers, title rules and small functions that no query with SQL holds to account."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import measure, quality
from tessera.streaming import monitors


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_first_seen_and_kept_listings(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = [("a", day(n)) for n in (0, 0, 30, 46, 80, 92)] + [("b", day(5)), ("b", day(6)), ("c", None)]
    spark.createDataFrame(rows, "k string, d date").withColumn("ts", F.col("d").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, d date, ts timestamp").parquet(str(tmp_path / "in"))
    got = sorted((r["k"], r["kept_day"]) for r in drained(monitors.kept_listings(stream(), "k", "d", 45), "kept"))
    want = sorted((r["k"], r["kept_day"]) for r in quality.relist_collapse(spark.createDataFrame(rows, "k string, d date"), ["k"], "d", 45).where("kept_day is not null").collect())
    assert got == want == [("a", day(0)), ("a", day(46)), ("a", day(92)), ("b", day(5))]
    seen = drained(monitors.first_seen(stream().where("d is not null"), "k", "ts"), "seen")
    assert sorted(r["k"] for r in seen) == ["a", "b"]


def test_logistic_drivers_are_those_of_newton(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 2))
    group = r.integers(0, 2, 3000)
    w = r.uniform(0.5, 2, 3000)
    y = (r.random(3000) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] + 0.7 * group - 0.3)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), "xy"[g], float(c), float(v)) for (a, b), g, c, v in zip(x, group, y, w, strict=True)], "a double, b double, g string, y double, w double")
    got = {r["feature"]: r["coefficient"] for r in measure.logistic_drivers(df, "y ~ a + b + g", "w", rounds=100).collect()}
    level = next(f for f in got if f.startswith("g"))
    m = np.column_stack([x, (group == "xy".index(level[-1])).astype(float), np.ones(3000)])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ beta))
        beta += np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m, m.T @ (w * (y - p)))
    assert [got["a"], got["b"], got[level]] == pytest.approx(list(beta[:3]), abs=2e-3)
    rows = measure.logistic_drivers(df, "y ~ a + b + g", "w").collect()
    assert [abs(r["coefficient"]) for r in rows] == sorted((abs(r["coefficient"]) for r in rows), reverse=True) and 0.6 < rows[0]["auc"] < 0.9


def test_first_title_rule_decides(spark):
    titles = [re.sub(r"\\b|\(|\)", "", p).replace("ml|machine learning|ai", w) for p, _ in C.TITLE_RULES for w in ("ml", "ai")]
    titles += ["Senior " + t.title() + " II" for t in titles] + ["Sales Engineer", "GPU Cluster Engineer", "Chef", "", "Bioengineering", "Customer Success Engineer"]
    plain = lambda t: next((label for p, label in C.TITLE_RULES if re.search(p, t.lower())), "other")
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", C.first_rule(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [plain(r["t"]) for r in got]


def test_fingerprints_and_blanks(spark):
    rows = [("Senior  C++ Dev (m/f)", "Berlin"), ("senior c   dev m f", "Berlin"), ("x", None)]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string, p string").select(C.fingerprint(F.col("t"), F.col("p")).alias("f")).collect()]
    assert got[0] == got[1] == "senior c dev m f|Berlin"
    assert [r[0] for r in spark.createDataFrame([(None,), ("  ",), (" a ",)], "x string").select(C.blank_default(F.col("x"), "d")).collect()] == ["d", "d", "a"]


def test_join_loss(spark):
    a = spark.createDataFrame([(" k1 ",), ("K1",), ("k2",), (None,)], "key string")
    b = spark.createDataFrame([("K1",), ("K1",)], "key string")
    assert tuple(quality.join_loss(a, b, "key").first()) == (4, 1, 3)
    assert tuple(quality.join_loss(*quality.clean_keys([a, b], "key"), "key").first()) == (4, 2, 2)
