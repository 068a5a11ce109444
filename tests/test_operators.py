"""Operators of the measurement engine on small hand-made frames."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boards
from tessera.functions import columns as C
from tessera.operators import panel, quality, reconcile, resolve, signals, windows
from tessera.plans import catalogue
from tessera.plans import cuts as _cuts  # noqa: F401 (its queries join the catalogue)
from tessera.plans import feeds as _feeds  # noqa: F401
from tessera.plans import panelstudy as _study  # noqa: F401
from tessera.plans import signals as _more  # noqa: F401
from tessera.plans import vendorstudy as _vendors  # noqa: F401
from tessera.sources import files, filings, postings
from tessera.streaming import monitors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    # the SQL of raked estimates does not join small cells, which the smallest tables have (test_panel.py covers them)
    d = "/root/testdata/" + ("sf0.01" if name.startswith(("estimate_m", "rake_weights")) else "sf0.001")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, d).toPandas(), con.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert_same_rows(got, want)


def assert_same_rows(got, want):
    """Whole rows are compared, sorted by all columns that are no floating-point numbers and then by those."""
    columns = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))

    def rows(frame):
        x = frame[columns].astype(object).where(frame[columns].notna(), None)
        plain = lambda v: v if v is None or isinstance(v, (bool, np.bool_, str)) else float(v) if isinstance(v, (float, int, np.number, decimal.Decimal)) else str(v)[:10] if hasattr(v, "year") else str(v)
        found = [tuple(plain(v) for v in r) for r in x.itertuples(index=False, name=None)]
        return sorted(found, key=lambda r: tuple((v is None, str(v) if isinstance(v, str) else "", round(v, 5) if isinstance(v, float) else 0.0, v is True) for v in r))

    for a, b in zip(rows(got), rows(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and (np.isclose(x, y, rtol=1e-9, atol=1e-6) or x != x and y != y)), (a, b)


def test_merchant_core(spark):
    for raw, core in (("SQ *Acme Tools #4821", "ACME TOOLS"), ("PAYPAL *FOO.COM", "FOO.COM"), ("Box#4821", "BOX"), ("Acme  Inc.", "ACME"), ("acme 512-555-0100", "ACME")):
        assert one(spark, C.merchant(F.col("r")), r=raw) == core
    assert one(spark, C.descriptor_core(F.col("r")), r="netflix-4 x9 77a") == "NETFLIX"


def test_text_rules(spark):
    assert one(spark, C.tokens(F.col("r")), r="Grimble's Co-op_Ltd ") == ["grimbles", "co", "op", "ltd"]
    assert one(spark, C.slugs(F.col("r")), r="The Acme Tools, Inc") == ["acmetools", "acme-tools", "acme_tools", "theacmetoolsinc"]
    assert one(spark, C.workplace(F.col("a"), F.col("b"), F.col("c")), a="Berlin, hybrid", b="", c="Remote") == "remote"
    assert one(spark, C.workplace(F.col("a"), F.col("b"), F.col("c")), a="Berlin", b="work from home", c="") == "remote"
    assert one(spark, C.title_score(F.col("q"), F.col("t")), q="data engineer", t="Senior Data Engineer") == 1.0
    assert one(spark, C.title_score(F.col("q"), F.col("t")), q="data data x", t="data") == pytest.approx(0.667)
    assert one(spark, C.first_rule(F.col("t")), t="GPU Sales Engineer") == "sales"
    assert one(spark, C.category(F.col("t")), t="CLOUD DATA") == "Data Infrastructure"
    assert one(spark, C.plain_html(F.col("t")), t="<p>a &amp; b</p><script>x</script>") == "a & b"


def test_scale_and_fiscal(spark):
    assert one(spark, C.scale_mixup(F.col("a"), F.col("b")), a=5.0, b=5100.0)
    assert not one(spark, C.scale_mixup(F.col("a"), F.col("b")), a=5.0, b=500000.0)
    assert not one(spark, C.scale_mixup(F.col("a"), F.col("b")), a=0.0, b=500.0)
    assert one(spark, C.fiscal_label(F.col("d")), d=datetime.date(2024, 5, 31)) == "FY2023"


def test_gap_fill(spark):
    def fill(bits):
        df = spark.createDataFrame([(1, n, bool(b)) for n, b in enumerate(bits)], "k int, n int, p boolean")
        return [int(r["f"]) for r in df.withColumn("f", windows.gap_fill("p", ["k"], ["n"])).orderBy("n").collect()]

    for code in range(5, 1 << 7, 9):  # series of seven periods
        bits = [code >> k & 1 for k in range(7)]
        want = [int(b or (0 < k < 6 and bits[k - 1] and bits[k + 1])) for k, b in enumerate(bits)]
        assert fill(bits) == want


def test_percentile_rank_skips_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 30.0), (1, None)], "g int, v double")
    got = sorted((r["p"] for r in df.withColumn("p", windows.percentile_rank("v", ["g"])).collect()), key=lambda x: -1 if x is None else x)
    assert got == [None, 50.0, 50.0, 100.0]


def test_relist_window_restarts_from_the_last_kept(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    df = spark.createDataFrame([("a", day(n)) for n in (0, 0, 30, 46, 80, 92)], "k string, d date")
    assert [r["kept_day"] for r in quality.relist_collapse(df, ["k"], "d", 45).orderBy("kept_day").collect()] == [day(0), day(46), day(92)]


def test_reconcile_precedence(spark):
    d = datetime.date(2024, 12, 31)
    far = datetime.date(2024, 6, 30)
    rows = [("scale", "edgar", 1000.0, d), ("scale", "fmp", 1.0, far), ("period", "edgar", 100.0, d), ("period", "fmp", 150.0, far), ("one", "x", 1.0, d), ("agree", "fmp", 100.0, d), ("agree", "polygon", 100.4, d),
            ("minor", "edgar", 100.0, d), ("minor", "zeta", 101.5, d), ("material", "fmp", 100.0, d), ("material", "polygon", 120.0, d)]
    got = {r["k"]: r for r in reconcile.reconcile(spark.createDataFrame(rows, "k string, source string, value double, period_end date"), ["k"]).collect()}
    assert {k: r["classification"] for k, r in got.items()} == {"scale": "unit_scale_mismatch", "period": "period_misalignment", "one": "single_source", "agree": "agreement", "minor": "minor_divergence", "material": "material_divergence"}
    assert got["agree"]["resolved_source"] == "fmp" and not got["agree"]["regulatory_anchor"] and got["minor"]["outlier"] == "zeta"


def test_staged_resolution(spark):
    vendors = spark.createDataFrame([("Acme", "ACME TOOLS"), ("Zed", "ZEDCORP SYSTEMS")], "vendor string, alias string")
    raw = spark.createDataFrame([("ACME TOOLS",), ("BUY ACME TOOLS NOW",), ("ZEDCORP SYSTEMZ",), ("QQQQ",)], "core string")
    got = {r["core"]: (r["method"], r["vendor"]) for r in resolve.resolve(raw, vendors).collect()}
    assert got["ACME TOOLS"] == ("exact", "Acme") and got["BUY ACME TOOLS NOW"] == ("exact", "Acme")
    assert got["QQQQ"] == ("unmatched", None) and got["ZEDCORP SYSTEMZ"][1] in ("Zed", None)


def test_greedy_match_is_one_to_one(spark):
    of = lambda xs: spark.createDataFrame([("v", x) for x in xs], "k string, period long")
    got = {r["event_period"]: r["flag_period"] for r in resolve.greedy_match(of([3, 4]), of([2, 4]), ["k"], 1).collect()}
    assert got == {3: 2, 4: 4}


def test_scripts_and_files(spark, tmp_path):
    assert files.statements("-- a\nselect 1;\nselect 2;\n") == ["select 1", "select 2"]
    assert list(files.cuts("-- @cut: a\nselect 1;\n-- @cut: b\nselect 2;")) == ["a", "b"]
    df = spark.createDataFrame([("x", 1.5)], "k string, v double")
    files.write_csv(df, str(tmp_path / "c"), ["k", "v"])
    assert files.csv_text(spark, str(tmp_path / "c")).collect()[0]["v"] == "1.5000"
    assert "k" in files.render(df) and '"v": 1.5' in files.metrics(df)


def test_streaming_monitor(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(at, "a", 1.0), (at, "a", 2.0), (at + datetime.timedelta(days=9), "b", 3.0)], "ts timestamp, k string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "e"))
    q = monitors.windowed(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["k"], r["n"], r["total"]) for r in spark.table("closed").collect()] == [("a", 2, 3.0)]


def test_boards(spark):
    cases = {
        "https://boards.greenhouse.io/acme/jobs/1": ("greenhouse", "acme"), "https://boards-api.greenhouse.io/v1/boards/acme/jobs": ("greenhouse", "acme"), "https://boards.greenhouse.io/embed/job_board?for=acme": ("greenhouse", "acme"),
        "https://jobs.lever.co/acme/1-2": ("lever", "acme"), "https://api.lever.co/v0/postings/acme?mode=json": ("lever", "acme"), "https://api.ashbyhq.com/posting-api/job-board/Acme": ("ashby", "Acme"),
        "https://jobs.smartrecruiters.com/Acme/1": ("smartrecruiters", "Acme"), "https://example.com/acme": (None, None), "https://jobs.lever.co/": (None, None), "no url": (None, None),
    }
    for url, want in cases.items():
        assert tuple(one(spark, boards.board(F.col("u")), u=url)) == want, url
    html = '<title>T</title><h1>Jobs <b>now</b></h1><a href="/jobs/1">One</a><a href="/jobs/1">Again</a><a href="/about">No</a><a href="/careers"></a> work from home'
    got = one(spark, boards.page(F.col("h")), h=html)
    assert (got["title"], got["workplace"], [tuple(x) for x in got["links"]]) == ("Jobs now", "remote", [("One", "/jobs/1")])


def test_filings(spark):
    edgar = '{"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"form": "10-K", "fp": "FY", "start": "2023-01-01", "end": "2023-12-31", "val": 10, "filed": "2024-02-01"},' \
            '{"form": "10-K", "fp": "FY", "start": "2023-10-01", "end": "2023-12-31", "val": 3, "filed": "2024-03-01"}, {"form": "10-Q", "fp": "Q3", "end": "2023-09-30", "val": 4, "filed": "2024-03-01"}]}},' \
            '"RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [{"form": "10-K", "fp": "FY", "start": "2023-01-01", "end": "2023-12-31", "val": 11, "filed": "2024-02-01"}]}}, "Other": {"units": {"stones": []}}}}}'  # fmt: skip
    polygon = '{"results": [{"timeframe": "annual", "fiscal_year": "2023", "end_date": "2023-12-31", "financials": {"income_statement": {"revenues": {"value": 2, "unit": "%s"}}}}]}'
    rows = [("edgar", "acme", edgar), ("fmp", "acme", '{"income_statement": [{"period": "FY", "calendarYear": "2023", "date": "2023-12-31", "revenue": 10.5, "epsdiluted": 1.5}]}'), ("polygon", "acme", polygon % "millions of USD")]
    of = lambda rows: {(r["source"], r["metric"]): (r["value"], r["unit"], r["period"]) for r in filings.canonical(spark.createDataFrame(rows, "source string, ticker string, payload string")).collect()}
    assert of(rows) == {("edgar", "revenue"): (10.0, "USD", "FY2023"), ("fmp", "revenue"): (10.5, "USD", "FY2023"), ("fmp", "eps_diluted"): (1.5, "USD/share", "FY2023"), ("polygon", "revenue"): (2e6, "USD", "FY2023")}
    with pytest.raises(Exception, match="no rule for unit"):
        of([("polygon", "acme", polygon % "stones")])


def test_postings(spark):
    rows = [
        ("greenhouse", "a", '{"jobs": [{"id": 1, "title": "Data Engineer", "location": {"name": "Remote"}, "departments": [{"name": "Eng"}], "absolute_url": "u"}]}'),
        ("lever", "b", '[{"id": "x", "text": "Chef", "categories": {"location": "Rome", "team": "Food"}, "workplaceType": "onsite", "createdAt": 1704067200000, "applyUrl": "v"}, {"text": "Cook", "createdAt": "never"}]'),
        ("ashby", "c", '{"jobs": [{"id": "y", "title": "Baker", "location": "Oslo", "isRemote": true}]}'),
        ("smartrecruiters", "d", '{"content": [{"id": "z", "name": "Data engineer II", "location": {"city": "Bern", "country": "ch"}}]}'),
        ("lever", "broken", "not json"),
    ]
    p = postings.postings(spark.createDataFrame(rows, "platform string, token string, payload string")).cache()
    got = {r["title"]: r for r in p.collect()}
    assert set(got) == {"Data Engineer", "Chef", "Cook", "Baker", "Data engineer II"}
    assert got["Data Engineer"]["workplace"] == got["Baker"]["workplace"] == "remote" and got["Chef"]["workplace"] == "onsite" and got["Cook"]["workplace"] == "unknown"
    assert (got["Chef"]["posted_at"], got["Chef"]["department"], got["Chef"]["url"], got["Cook"]["posted_at"]) == ("2024-01-01", "Food", "v", None)
    assert got["Data engineer II"]["location"] == "Bern, ch" and got["Data engineer II"]["url"].endswith("/d/z")
    assert sorted(r["token"] for r in postings.matching(p, "data eng").collect()) == ["a", "d"]
    assert postings.best_title(p, "data engineer").count() == 2


def test_coverage_and_composite(spark):
    cols = "v int, q int, seg string, jobs_tracked boolean, jobs_n int, web_months int, spend_presence string, cliff boolean, jobs_growth double, web_growth double, spend_growth double"
    rows = [
        (1, 1, "s", True, 3, 1, "present", False, 0.1, 0.2, 0.3), (1, 2, "s", True, 0, 0, "absent", False, None, None, None), (1, 3, "s", True, 0, 0, "absent", False, None, None, None),
        (2, 1, "s", False, 0, 1, "present", False, None, 0.1, 0.5), (2, 2, "s", True, 1, 0, "thin", True, 0.2, None, None), (2, 3, "s", True, 1, 1, "absent", True, 0.2, 0.1, None),
    ]
    d = signals.coverage(spark.createDataFrame(rows, cols), ["v"], ["q"])
    got = {(r["v"], r["q"]): (r["tier"], r["tier_reason"]) for r in d.collect()}
    assert got == {(1, 1): ("A", "full"), (1, 2): ("C", "post_shutdown_dark"), (1, 3): ("C", "no_spend_channel"), (2, 1): ("B", "untracked_jobs"), (2, 2): ("C", "below_traffic_floor"), (2, 3): ("B", "coverage_cliff")}
    c = {(r["v"], r["q"]): r["composite"] for r in signals.composite(d, ["seg", "q"]).collect()}
    assert c[1, 2] == 50.0 and c[1, 1] == pytest.approx(0.35 * 100 + 0.2 * 100 + 0.45 * 50) and c[2, 2] == 75.0
    f = signals.flags(spark.createDataFrame([(1, n, x) for n, x in enumerate((40.0, 40.0, 60.0, 30.0, 30.0))], "v int, q int, composite double"), ["v"], ["q"])
    assert [(r["accel_flag"], r["stall_flag"]) for r in f.orderBy("q").collect()] == [(False, False), (False, False), (True, False), (False, True), (False, True)]
    s = {r["threshold"]: (r["n_accel"], r["n_stall"]) for r in signals.sensitivity(f.drop("delta"), ["v"], ["q"]).collect()}
    assert s == {10.0: (1, 2), 15.0: (1, 2), 20.0: (1, 1)}


def test_own_horizon_hides_late_facts(spark):
    df = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 1, 2, 5.0), ("a", 1, 3, 7.0), ("a", 2, 2, 1.0)], "k string, p int, seen int, x double")
    got = {r["p"]: tuple(r)[2:] for r in signals.at_own_horizon(df, ["k"], "p", "seen", "x").collect()}
    assert got == {1: (1, 0, 10.0, 0.0), 2: (1, 2, 1.0, 15.0), 3: (0, 1, 0.0, 1.0)}


def test_tail_tags(spark):
    vendors = spark.createDataFrame([("Acme", "ACME TOOLS", "Security")], "vendor string, alias string, category string")
    found = spark.createDataFrame([("A", "exact", 1.0, "Acme"), ("ACME TOOLZ", "review", 0.8, "Acme"), ("ACNE TOLS", "unmatched", 0.1, None), ("QQ CLOUD", "unmatched", 0.0, None), ("PY DATA", "review", 0.79, "Acme"), ("LOST", "unmatched", 0.0, None)], "core string, method string, score double, vendor string")
    tags = resolve.tag_tail(found.where("method in ('review', 'unmatched') and core <> 'LOST'"), vendors)
    got = {r["core"]: (r["final_method"], r["final_vendor"], r["new_vendor_flag"]) for r in resolve.merge_tags(found, tags).collect()}
    assert got == {"A": ("exact", "Acme", 0), "ACME TOOLZ": ("tagger_review", "Acme", 0), "ACNE TOLS": ("tagger_tail", "Acme", 0), "QQ CLOUD": ("new_vendor_candidate", "", 1), "PY DATA": ("review_unconfirmed", "Acme", 0), "LOST": ("tagger_dropped", "", 0)}
    assert {r["core"]: r["category_guess"] for r in tags.collect()}["QQ CLOUD"] == "Cloud Infrastructure"
    assert [r["core"] for r in resolve.covered_once(found.where("method <> 'exact'"), tags, "core").collect()] == ["LOST"]
