"""Readers, sinks and live sources with a stand-in for the network; simulated worlds and the studies over them."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import study
from tessera.operators import signals, vendors
from tessera.sources import files, filings, live, panelworld, postings, vendorworld


def test_fetch_tries_again_and_gives_up():
    waits, answers = [], [(503, b""), (429, b""), (200, b'{"a": 1}')]
    assert live.fetch("http://x", {}, lambda *_: answers.pop(0), sleep=waits.append) == {"a": 1} and waits == [2.0, 4.0]
    with pytest.raises(live.Unavailable, match="after 3 attempts"):
        live.fetch("http://x", {}, lambda *_: (500, b""), sleep=waits.append)
    with pytest.raises(live.Unavailable, match="status 404"):
        live.fetch("http://x", {}, lambda *_: (404, b""), sleep=waits.append)


def test_sources_skip_without_key_and_resolve_numbers(monkeypatch):
    monkeypatch.delenv("FMP_API_KEY", raising=False)
    monkeypatch.setenv("POLYGON_API_KEY", "k")
    asked = []

    def get(url, headers):
        asked.append(url)
        return 200, json.dumps({"0": {"ticker": "Abc", "cik_str": 42}} if "tickers" in url else {"results": []}).encode()

    edgar, fmp, polygon = (live.Source(x.name, x.key, get, 0.0) for x in live.sources())
    edgar.payload("abc")
    assert asked[-1].endswith("CIK0000000042.json") and polygon.payload("abc") == {"results": []} and "apiKey=k" in asked[-1]
    with pytest.raises(live.Unavailable, match="FMP_API_KEY"):
        fmp.payload("abc")
    with pytest.raises(live.Unavailable, match="no number"):
        edgar.payload("zzz")
    monkeypatch.setenv("FMP_API_KEY", "q")
    assert fmp.payload("abc") == {"symbol": "ABC", "income_statement": [], "balance_sheet": [], "cash_flow": []}


def test_saved_payloads_reach_the_readers(spark, tmp_path):
    (tmp_path / "polygon").mkdir()
    (tmp_path / "polygon" / "ABC.json").write_text(json.dumps({"results": [{"timeframe": "annual", "fiscal_year": "2023", "end_date": "2023-12-31", "filing_date": "2024-02-01", "financials": {"income_statement": {"revenues": {"value": 5.0, "unit": "USD"}}}}]}))
    found, notices = live.payloads(spark, str(tmp_path))
    rows = filings.canonical(found).collect()
    assert [(r["ticker"], r["metric"], r["value"]) for r in rows] == [("ABC", "revenue", 5.0)] and notices == []
    assert live.payloads(spark, str(tmp_path), ["zzz"])[0].count() == 0


def test_asked_payloads_and_notices(spark, monkeypatch):
    monkeypatch.delenv("FMP_API_KEY", raising=False)
    polygon = live.Source("polygon", None, lambda *_: (200, b'{"results": []}'))
    df, notices = live.asked(spark, ["b", "a"], [polygon, live.Source("fmp", "FMP_API_KEY")])
    assert notices == ["skipping fmp: FMP_API_KEY is not set"]
    assert sorted((r["ticker"], r["payload"]) for r in df.collect()) == [("a", '{"results": []}'), ("b", '{"results": []}')]


def test_boards_are_probed_in_order():
    def get(url, _):
        return (200, b'[{"id": "1"}]') if "lever" in url and "acme-corp" in url else (404, b"")

    assert live.probe(["acmecorp", "acme-corp"], get) == ("lever", "acme-corp", [{"id": "1"}])
    assert live.probe(["none"], get) is None
    assert live.posting("ashby", "x", "2", lambda *_: (200, b'{"jobs": [{"id": "1"}, {"id": "2", "title": "t"}]}')) == {"id": "2", "title": "t"}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 1234.5, 10_000), ("y", None, 2)], "k string, v double, n long")
    assert "1,234.5000" in files.render(df) and "10,000" in files.markdown(df, "T") and files.percent(0.1234) == "12.3%"
    with pytest.raises(ValueError):
        files.render(df, most=1)
    files.chart(df, "k", ["v", "n"], str(tmp_path / "c.svg"))
    assert (tmp_path / "c.svg").read_text().count("polyline") == 2
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,\n")
    assert files.csv_view(spark, str(tmp_path / "a.csv"), "seen").dtypes == [("a", "int"), ("b", "string")] and spark.sql("select sum(a) from seen").first()[0] == 3
    assert files.csv(spark, str(tmp_path / "a.csv"), "a long, b string").dtypes[0] == ("a", "bigint")
    r = files.Registry()
    r.add("seen", lambda: files.csv_text(spark, str(tmp_path / "a.csv")))
    assert r.ref("seen") is r.ref("seen") and r.ref("seen").where("b = ''").count() == 1
    with pytest.raises(ValueError):
        r.add("seen", lambda: df)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b.json").write_text('{"x": 2}')
    (tmp_path / "j" / "a.json").write_text('{"x": 1}')
    assert [(x["file"], x["x"]) for x in files.json_documents(spark, str(tmp_path / "j"), "x int").collect()] == [("a.json", 1), ("b.json", 2)]


def test_panel_study_finds_what_was_planted(spark, tmp_path):
    w = panelworld.World(people=2500, panel=600, wave=(16, 150))
    f = study.steps(spark, w, str(tmp_path / "t"), None, 2, 5)
    assert [str(r["day"]) for r in f["doubled_days"].collect()] == [w.doubled]
    assert [r["month"] for r in f["waves"].collect()] == [w.wave[0]]
    assert (w.outage[0], w.outage[1], w.outage[2]) in [(r["instrument"], str(r["first"]), str(r["last"])) for r in f["outages"].collect()]
    assert [(r["company"], r["new_core"]) for r in f["renamed"].collect()] == [("Verge", w.renamed[2])]
    error = {(r["method"], r["kpi"]): r["mape"] for r in f["scorecard"].collect()}
    assert error["m4", "revenue"] < error["m3", "revenue"] < error["m1", "revenue"] and error["m4", "revenue"] < 15
    t = {(r["company"], r["quarter"]): r for r in f["truth"].collect()}
    assert all(t["Lumen", q]["actives"] == t["Lumen", q - 1]["actives"] + t["Lumen", q]["gross_adds"] - t["Lumen", q]["churned"] for q in range(1, 12))
    assert all(t["Verge", q]["actives"] == t["Verge", q - 1]["actives"] + t["Verge", q]["gross_adds"] - t["Verge", q]["churned"] for q in range(1, 12))
    ids = spark.read.parquet(str(tmp_path / "t" / "raw")).agg(F.min("txn_id"), F.max("txn_id"), F.count("*"), F.count_distinct("txn_id")).first()
    assert ids[0] == 1 and ids[1] == ids[2] == ids[3]
    study.write({k: f[k] for k in study.ORDER}, str(tmp_path / "out"))
    assert files.csv_text(spark, str(tmp_path / "out" / "scorecard")).count() == 24
    assert panelworld.planted(w)[0][0] == "doubled_day"


def test_vendor_world_and_signals(spark, tmp_path):
    w = vendorworld.Vendors(count=60)
    of = files.settled(vendorworld.vendors(spark, w), str(tmp_path / "v"))
    p = files.settled(vendorworld.paths(of, w), str(tmp_path / "p"))
    assert p.groupBy("vendor", "quarter").count().where("count > 1").count() == 0 and p.where("arr <= 0").count() == 0
    storm, spike, fading = (vendorworld.planted(p, q, least, w, salt) for q, least, salt in ((w.storm, 4, 61), ((w.spike,), 0, 62), ((w.renamed, w.renamed + 1), 0, 63)))
    posts, web, spend = vendorworld.postings(p, storm, w), vendorworld.traffic(p, spike, w), vendorworld.spend(p, fading, w)
    jobs = files.settled(vendors.jobs_features(posts, of, w.quarters).drop("mix"), str(tmp_path / "j"))
    stormy = jobs.join(storm, "vendor").where(F.col("quarter").between(*w.storm)).agg(F.sum("jobs_raw"), F.sum("jobs_n")).first()
    assert stormy[0] > 2 * stormy[1]  # relistings collapse
    known = vendorworld.descriptor_map(of)
    money = files.settled(vendors.spend_features(spend, known, w.quarters), str(tmp_path / "s"))
    assert money.where("spend_presence = 'present'").count() > 50
    visits = files.settled(vendors.web_features(web, vendors.source_growth(jobs, money), of, w.quarters), str(tmp_path / "w"))
    d = files.settled(vendors.scored(jobs, visits, money, of), str(tmp_path / "d"))
    assert {r["tier"] for r in d.select("tier").distinct().collect()} <= {"A", "B", "C"} and d.where("composite is null").count() == 0
    e = p.where("inflection is not null").select("vendor", "quarter", F.col("inflection").alias("type"))
    naive = vendors.jobs_features(posts, of, w.quarters, qa=False)
    assert naive.where("jobs_n <> jobs_raw").count() == 0
    grid = vendors.inflection_grid(d, e).collect()
    assert len(grid) == 12 and sum(r["n_events"] for r in grid if r["k"] == 1) == e.count()
    strip = [r["n_flags"] for r in vendors.threshold_strip(d, e).orderBy("threshold").collect()]
    assert strip == sorted(strip, reverse=True)
    equal = signals.flags(signals.composite(d.drop("composite", "delta", "accel_flag", "stall_flag", *[f"{s}_pct" for s in signals.WEIGHTS]), ["segment", "quarter"], dict.fromkeys(signals.WEIGHTS, 1 / 3)), ["vendor"], ["quarter"])
    assert equal.count() == d.count()
    assert vendors.shutdown_validation(d, p).first()["n_shutdowns"] == p.where("event = 'shutdown'").count()
    lv = vendors.levels(d)
    assert lv.where("level_method = 'none' and level_band <> 'no_data'").count() == 0
    assert vendors.acquisition_validation(lv, vendorworld.disclosures(p)).where("true_band is null").count() == 0
    assert vendorworld.titles(spark).count() == 150


def test_roles_are_verified(spark):
    job = lambda i, t, place="", kind=None: {"id": i, "text": t, "categories": {"location": place}, "workplaceType": kind}
    payload = json.dumps([job("1", "Data Engineer", "Berlin", "remote"), job("2", "Data Engineer II", "Hybrid, Berlin"), job("3", "Chef", "Rome")])
    boards = spark.createDataFrame([("Acme", "lever", "acme", payload), ("Void", "lever", "void", "[]")], "company string, platform string, token string, payload string")
    roles = spark.createDataFrame([("Acme", "data engineer"), ("Acme", "Data Engineer II"), ("Acme", "chef"), ("Acme", "astronaut"), ("Void", "chef"), ("None", "chef")], "company string, title string")
    got = {(r["company"], r["title"]): (r["verdict"], r["matched_title"], r["found"]) for r in postings.verified(roles, boards).collect()}
    assert got["Acme", "data engineer"] == ("remote-eligible", "Data Engineer", True) and got["Acme", "Data Engineer II"] == ("hybrid", "Data Engineer II", True)
    assert got["Acme", "chef"] == ("ambiguous", "Chef", True) and got["Acme", "astronaut"] == ("not-found", None, False)
    assert got["Void", "chef"] == ("not-found", None, False) and got["None", "chef"] == ("unresolved", None, False)
