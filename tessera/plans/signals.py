"""More queries of the catalogue: signals by period, filings, postings and pages, tags and bridges."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import shared_folder
from ..functions import boards
from ..functions import columns as C
from ..operators import panel, quality, resolve, signals, tagging, windows
from ..sources import filings, postings
from .catalogue import _DAILY, _DAY, _M, _Q, _UD, daily, orders_q, query, t, user_days


@query(f"""WITH r AS (SELECT c_mktsegment AS seg, {_Q} AS qi, {_M} AS rep, (2 * sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS est FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
x AS (SELECT *, CASE WHEN est > 0 AND rep > 0 THEN ln(rep / est) END AS lr FROM r),
j AS (SELECT a.seg, a.qi, b.lr, row_number() OVER (PARTITION BY a.seg, a.qi ORDER BY b.qi DESC) AS k FROM x a LEFT JOIN x b ON a.seg = b.seg AND b.qi < a.qi AND b.lr IS NOT NULL),
f AS (SELECT seg, qi, coalesce(exp(avg(lr)), 1.0) AS factor FROM j WHERE k <= 3 GROUP BY ALL)
SELECT seg, qi, est AS raw, round(factor, 8) AS factor, round(est * factor, 2) AS calibrated FROM x JOIN f USING (seg, qi)""")
def calibrated_estimate(s: SparkSession, d: str) -> DataFrame:
    """What settled orders alone would say, scaled up and calibrated by its last three ratios to the reported total."""
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    o = orders_q(s, d).join(t(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("seg", "qi").agg(F.sum(cents).cast("double").alias("rep"), (2 * F.sum(F.when(F.col("o_orderstatus") == "F", cents))).cast("double").alias("raw"))
    g = panel.prior_ratio(g, ["seg"], "qi", "rep", "raw")
    return g.select("seg", "qi", "raw", F.round("factor", 8).alias("factor"), F.round(F.col("raw") * F.col("factor"), 2).alias("calibrated"))


@query("""WITH k AS (SELECT unnest(['A', 'N', 'R', 'X']) AS flag), c AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT k.flag, coalesce(sum(n), 0)::BIGINT AS n, coalesce(string_agg(status || ':' || n::VARCHAR, ',' ORDER BY status), '') AS statuses FROM k LEFT JOIN c USING (flag) GROUP BY k.flag""")
def map_collect(s: SparkSession, d: str) -> DataFrame:
    """Counts by flag of a fixed list, zero ones too, with a map of status to count; a status twice would raise."""
    c = t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    g = c.groupBy("flag").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    flags = s.range(1).select(F.explode(F.array(*map(F.lit, "ANRX"))).alias("flag"))
    return flags.join(g, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(shown, F.lit("")).alias("statuses"))


@query(f"""WITH {_UD}, x AS (SELECT *, lag(n) OVER w AS a, lag(n, 2) OVER w AS b, lag(n, 3) OVER w AS c, max(n > 0) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, n, coalesce(before AND n = 0 AND a = 0, false) AS freeze, coalesce(a > 0, false) AS prior_present, round(ln((n + a) / 2.0::DOUBLE + 1) - ln((b + c) / 2.0::DOUBLE + 1), 8) AS growth FROM x""")
def freeze_flag(s: SparkSession, d: str) -> DataFrame:
    by, order = ["user_id"], ["day"]
    prior = F.coalesce(F.lag("n").over(W.partitionBy("user_id").orderBy("day")) > 0, F.lit(False))
    return user_days(s, d).select("user_id", "day", "n", signals.frozen("n", by, order).alias("freeze"), prior.alias("prior_present"), F.round(signals.smooth_growth("n", by, order), 8).alias("growth"))


@query(f"""WITH m AS (SELECT n_name, {_Q} AS qi, date_trunc('month', o_orderdate) AS mon, {_M} AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
q AS (SELECT n_name, qi, sum(v::DECIMAL(18,2))::DOUBLE AS total, avg(ln(greatest(v, 1.0))) AS mean_log FROM m GROUP BY ALL)
SELECT q.n_name, q.qi, q.total, round(CASE WHEN q.total > 0 AND p.total > 0 THEN ln(q.total) - ln(p.total) END, 8) AS growth, round(q.mean_log - p.mean_log, 8) AS mean_log_growth FROM q LEFT JOIN q p ON p.n_name = q.n_name AND p.qi = q.qi - 1""")
def log_growth(s: SparkSession, d: str) -> DataFrame:
    """Growth of quarterly sums, and of the mean log of the months seen; against the quarter before by the calendar."""
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = o.groupBy("n_name", "qi", F.trunc("o_orderdate", "MM").alias("mon")).agg(C.money("o_totalprice").alias("v"))
    q = m.groupBy("n_name", "qi").agg(C.money("v").alias("total"), F.avg(F.log(F.greatest("v", F.lit(1.0)))).alias("ml"))
    w = W.partitionBy("n_name").orderBy("qi")
    before = lambda c: F.when(F.lag("qi").over(w) == F.col("qi") - 1, F.lag(c).over(w))
    return q.select("n_name", "qi", "total", F.round(C.log_growth(F.col("total"), before("total")), 8).alias("growth"), F.round(F.col("ml") - before("ml"), 8).alias("mean_log_growth"))


@query(f"""WITH g AS (SELECT n_name, {_Q} AS qi, {_M} AS rev FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT *, 100.0::DOUBLE * (rank() OVER (PARTITION BY qi ORDER BY rev) + (count(*) OVER (PARTITION BY qi, rev) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY qi) AS composite FROM g),
x AS (SELECT *, composite - (lag(composite) OVER w + lag(composite, 2) OVER w) / 2 AS delta FROM c WINDOW w AS (PARTITION BY n_name ORDER BY qi))
SELECT n_name, qi, round(composite, 8) AS composite, round(delta, 8) AS delta, coalesce(delta >= 15 AND composite >= 55, false) AS accel_flag, coalesce(delta <= -15 AND composite <= 45, false) AS stall_flag FROM x""")
def prior_mean_flags(s: SparkSession, d: str) -> DataFrame:
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy("n_name", "qi").agg(C.money("o_totalprice").alias("rev")).withColumn("composite", windows.percentile_rank("rev", ["qi"]))
    return signals.flags(g, ["n_name"], ["qi"]).select("n_name", "qi", F.round("composite", 8).alias("composite"), F.round("delta", 8).alias("delta"), "accel_flag", "stall_flag")


@query("""WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 5 AS p, (date_diff('day', DATE '2024-01-01', ts::DATE) + event_id % 4) // 5 AS v, value::DECIMAL(18,2) AS x FROM events),
a AS (SELECT u.user_id, c.p AS horizon, count(*) FILTER (WHERE e.p = c.p) AS n_now, count(*) FILTER (WHERE e.p = c.p - 1) AS n_before, coalesce(sum(x) FILTER (WHERE e.p = c.p), 0)::DOUBLE AS a_now, coalesce(sum(x) FILTER (WHERE e.p = c.p - 1), 0)::DOUBLE AS a_before
 FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN (SELECT DISTINCT p FROM e) c LEFT JOIN e ON e.user_id = u.user_id AND e.v <= c.p AND e.p BETWEEN c.p - 1 AND c.p GROUP BY ALL)
SELECT user_id, horizon::INTEGER AS horizon, n_now::BIGINT AS n_now, (n_now + n_before)::BIGINT AS n_trailing, CASE WHEN n_now + n_before >= 8 THEN 'present' WHEN n_now + n_before > 0 THEN 'thin' ELSE 'absent' END AS presence,
round(CASE WHEN n_now + n_before >= 8 AND a_now > 0 AND a_before > 0 THEN ln(a_now) - ln(a_before) END, 8) AS growth FROM a""")
def presence_horizon(s: SparkSession, d: str) -> DataFrame:
    """Spans of five days, each seen with what was visible at its own end; events become visible up to three days late."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    span = lambda c: F.floor(c / 5).cast("int")
    e = t(s, d, "events").select("user_id", span(day).alias("horizon"), span(day + F.col("event_id") % 4).alias("seen"), "value")
    grid = windows.dense(e.select("user_id").distinct(), e.select("horizon").distinct())
    g = grid.join(signals.at_own_horizon(e, ["user_id"], "horizon", "seen", "value"), ["user_id", "horizon"], "left").fillna(0)
    n = F.col("n_now") + F.col("n_before")
    growth = F.when(n >= signals.PRESENT, C.log_growth(F.col("amount_now"), F.col("amount_before")))
    return g.select("user_id", "horizon", "n_now", n.alias("n_trailing"), signals.presence(n).alias("presence"), F.round(growth, 8).alias("growth"))


@query("""WITH x AS (SELECT lang AS method, CASE WHEN n_chars >= 20 THEN CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END END AS assigned, CASE WHEN toxic = 0 THEN quality END AS truth FROM documents JOIN labels USING (doc_id))
SELECT method, count(*)::BIGINT AS n, (count(*) FILTER (WHERE assigned = truth))::BIGINT AS n_correct, (count(*) FILTER (WHERE truth IS NULL))::BIGINT AS n_false_merges, (count(*) FILTER (WHERE assigned = truth))::DOUBLE / count(*) AS "precision"
FROM x WHERE assigned IS NOT NULL GROUP BY method""")
def method_precision(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    x = t(s, d, "documents").select("doc_id", F.col("lang").alias("method"), F.when(n >= 20, F.when(n >= 300, 1).otherwise(0)).alias("assigned"))
    truth = t(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("truth"))
    return resolve.method_precision(x.join(truth, "doc_id"), "method", "assigned", "truth")


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """Yearly revenue of nations as three sources would file it: restated facts, raw statements, thousands."""
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy(F.col("n_name").alias("ticker"), F.year("o_orderdate").alias("y")).agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("bigint").alias("v"))
    year, end, start = F.col("y").cast("string"), F.format_string("%d-12-31", "y"), F.format_string("%d-01-01", "y")
    fact = lambda value, filed: F.struct(F.lit("10-K").alias("form"), F.lit("FY").alias("fp"), start.alias("start"), end.alias("end"), value.alias("val"), F.format_string(filed, "y").alias("filed"))
    rows = g.groupBy("ticker").agg(
        F.flatten(F.collect_list(F.array(fact(F.col("v") + 1, "%d-12-31"), fact(F.col("v"), "%d-12-31x")))).alias("facts"),
        F.collect_list(F.struct(F.lit("FY").alias("period"), year.alias("calendarYear"), end.alias("date"), (F.col("v") + F.col("y") % 2).alias("revenue"))).alias("income"),
        F.collect_list(F.struct(F.lit("annual").alias("timeframe"), year.alias("fiscal_year"), end.alias("end_date"), F.struct(F.struct(F.struct(F.floor(F.col("v") / 1000).alias("value"), F.lit("thousands of USD").alias("unit")).alias("revenues")).alias("income_statement")).alias("financials"))).alias("results"),
    )
    edgar = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("facts").alias("USD")).alias("units")).alias("Revenues")).alias("us-gaap")).alias("facts")))
    each = {"edgar": edgar, "fmp": F.to_json(F.struct(F.lit("").alias("symbol"), F.col("income").alias("income_statement"))), "polygon": F.to_json(F.struct("results"))}
    return rows.select("ticker", F.explode(F.create_map(*[x for k, v in each.items() for x in (F.lit(k), v)])).alias("source", "payload"))


@query("""WITH g AS (SELECT n_name, year(o_orderdate) AS y, floor(sum(o_totalprice::DECIMAL(18,2)))::BIGINT AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
u AS (SELECT n_name, y, 'edgar' AS source, v::DOUBLE AS value, y::VARCHAR || '-12-31x' AS as_of FROM g UNION ALL SELECT n_name, y, 'fmp', (v + y % 2)::DOUBLE, y::VARCHAR || '-12-31' FROM g UNION ALL SELECT n_name, y, 'polygon', (v // 1000 * 1000)::DOUBLE, y::VARCHAR || '-12-31' FROM g)
SELECT upper(n_name) AS ticker, source, 'revenue' AS metric, 'FY' || y::VARCHAR AS period, make_date(y::INTEGER, 12, 31) AS period_end, value, 'USD' AS unit, as_of FROM u""")
def canonical_observations(s: SparkSession, d: str) -> DataFrame:
    return filings.canonical(_payloads(s, d))


@query(f"""WITH d AS ({_DAILY}), m AS (SELECT *, avg(n) OVER w AS m, median(n) OVER w AS med FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
c AS (SELECT event_type, day, n, n > 1.15 * m AS naive, CASE WHEN coalesce(n > 1.2 * m, false) THEN med ELSE n::DOUBLE END AS corrected FROM m),
q AS (SELECT *, corrected > 1.15 * avg(corrected) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS qa FROM c)
SELECT event_type, day, n, corrected, coalesce(naive, false) AS naive_flag, coalesce(qa, false) AS qa_flag FROM q WHERE coalesce(naive, false) <> coalesce(qa, false)""")
def naive_vs_qa(s: SparkSession, d: str) -> DataFrame:
    """Days whose flag changes once spikes are repaired."""
    by, order = ["event_type"], ["day"]
    over = lambda c, k: F.coalesce(F.col(c) > k * windows.trailing(F.avg(c), by, order, 6), F.lit(False))
    x = daily(s, d).withColumn("naive_flag", over("n", 1.15)).withColumn("spike", over("n", 1.2))
    x = x.withColumn("corrected", quality.winsorized("n", F.col("spike"), by, order).cast("double")).withColumn("qa_flag", over("corrected", 1.15))
    return x.where("naive_flag <> qa_flag").select("event_type", "day", "n", "corrected", "naive_flag", "qa_flag")


@query("""WITH f AS (SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' AND p_name LIKE 'red %' AND l_linenumber <> 7 THEN p_name || ' new' ELSE p_name END AS descriptor, p_name, o_custkey % 200 AS panelist, o_orderdate::DATE AS day, o_totalprice AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
own AS (SELECT * FROM f WHERE descriptor NOT LIKE '% new'), nw AS (SELECT * FROM f WHERE descriptor LIKE '% new'),
mon AS (SELECT p_name, date_trunc('month', day) AS m, count(*) AS n FROM own GROUP BY ALL), fade AS (SELECT p_name, arg_max(n, m) AS l, sum(n) AS t, count(*) AS k FROM mon GROUP BY 1),
a AS (SELECT p_name AS vendor, median(amount) AS mid, date_diff('day', min(day), max(day))::DOUBLE / nullif(count(*) - 1, 0) AS cad FROM own GROUP BY 1), b AS (SELECT descriptor, median(amount) AS mid, date_diff('day', min(day), max(day))::DOUBLE / nullif(count(*) - 1, 0) AS cad, count(DISTINCT panelist) AS people FROM nw GROUP BY 1),
s AS (SELECT x.vendor, y.descriptor, count(*) AS n FROM (SELECT DISTINCT p_name AS vendor, panelist FROM own) x JOIN (SELECT DISTINCT descriptor, panelist FROM nw) y USING (panelist) GROUP BY ALL),
j AS (SELECT s.descriptor, s.vendor, n::DOUBLE / people AS overlap, least(a.mid, b.mid) / greatest(a.mid, b.mid) AS amount_ratio, b.cad / a.cad AS cadence_ratio FROM s JOIN a USING (vendor) JOIN b USING (descriptor) JOIN fade ON fade.p_name = s.vendor WHERE k >= 2 AND l <= 0.7 * (t - l) / (k - 1))
SELECT descriptor, vendor, round(overlap, 8) AS overlap, round(amount_ratio, 8) AS amount_ratio, round(cadence_ratio, 8) AS cadence_ratio FROM (SELECT *, row_number() OVER (PARTITION BY descriptor ORDER BY vendor) AS r FROM j WHERE overlap > 0.5 AND amount_ratio >= 0.6 AND cadence_ratio BETWEEN 0.8 AND 1.25) WHERE r = 1""")
def descriptor_bridge(s: SparkSession, d: str) -> DataFrame:
    """Part names as descriptors, of which those of one colour are renamed for most lines from 2000 on."""
    p = t(s, d, "part").select("p_partkey", "p_name")
    x = t(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    renamed = (F.col("o_orderdate") >= "2000-01-01") & F.col("p_name").startswith("red ") & (F.col("l_linenumber") != 7)
    facts = x.select(F.when(renamed, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("descriptor"), (F.col("o_custkey") % 200).alias("panelist"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))
    out = signals.bridge(facts, p.select(F.col("p_name").alias("descriptor"), F.col("p_name").alias("vendor")).distinct())
    return out.select("descriptor", "vendor", *[F.round(c, 8).alias(c) for c in ("overlap", "amount_ratio", "cadence_ratio")])


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, len(regexp_extract_all(html, '<a href="[^"]*"'))::BIGINT AS n_anchors, url LIKE '%/en/%' AS english FROM pages""")
def html_anchors(s: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return t(s, d, "pages").select("page_id", (F.regexp_extract(h, "<title>([^<]*)</title>", 1) != "").alias("has_title"), F.size(F.regexp_extract_all(h, F.lit('<a href="[^"]*"'), F.lit(0))).cast("bigint").alias("n_anchors"), F.col("url").contains("/en/").alias("english"))


@query()
def html_links(s: SparkSession, d: str) -> DataFrame:
    """Title, workplace, excerpt and up to 25 labelled links of every page, all links of which count as hints."""
    read = t(s, d, "pages").select("page_id", "url", boards.parsed(F.col("html")).alias("r"))
    p = read.select("page_id", boards.page_of(F.col("r")).alias("p"), boards.hinted(F.col("r.links"), ("/",)).alias("links"), boards.board(F.col("url")).alias("b"))
    return p.select("page_id", "p.title", "p.workplace", "p.excerpt", F.size("links").alias("n_links"), F.get(F.col("links"), F.lit(0))["href"].alias("first_href"), "b.platform", "b.token")


@query()
def tagger_tail(s: SparkSession, d: str) -> DataFrame:
    """Part names with planted noise, resolved in stages; the tail goes to the tagger, whose answers are merged."""
    p, n = t(s, d, "part"), F.upper("p_name")
    k = F.col("p_partkey") % 4
    noisy = F.when(k == 0, F.reverse(n)).when(k == 1, F.concat(F.lit("ZX "), F.substring(n, 3, 20))).otherwise(n)
    raw = p.select("p_partkey", C.merchant(noisy).alias("core"))
    vendors = p.select(F.col("p_name").alias("vendor"), n.alias("alias"), F.substring_index("p_name", " ", -1).alias("category")).distinct()
    found = resolve.resolve(raw, vendors.select("vendor", "alias"))
    tail = found.where(F.col("method").isin("review", "unmatched"))
    return raw.join(resolve.merge_tags(found, resolve.tag_tail(tail, vendors)), "core", "left").select("p_partkey", "core", "method", "final_method", "final_vendor", "new_vendor_flag")


_HOST, _DOMAIN = re.compile(r"^[a-z]+://([^/?#]*)"), re.compile(r"\.([a-z]+)$")


def by_host(sent: dict[str, str]) -> list[dict]:
    """A tagger that guesses from the host of an address only."""
    out = []
    for i, url in sent.items():
        host = _HOST.search(url)
        host = host[1] if host else ""
        domain = _DOMAIN.search(host)
        out.append({"id": i, "vendor_guess": host, "category_guess": domain[1] if domain else "", "confidence": 0.5 if "?" in url else 1.0, "new_vendor_flag": int(host.startswith("m."))})
    return out


@query(r"""WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)
SELECT page_id, h AS vendor_guess, regexp_extract(h, '\.([a-z]+)$', 1) AS category_guess, CASE WHEN contains(url, '?') THEN 0.5 WHEN url IS NOT NULL THEN 1.0 END::DOUBLE AS confidence,
CASE WHEN h LIKE 'm.%' THEN 1 WHEN h IS NOT NULL THEN 0 END AS new_vendor_flag FROM x""")
def tagged_pages(s: SparkSession, d: str) -> DataFrame:
    """The address of every page through the ledger of a tagger, forty requests of 25 a task; a new ledger for each call."""
    pages = t(s, d, "pages").select("page_id", F.col("url").alias("text"))
    return tagging.tagged(pages, f"{shared_folder(s)}/tags-{uuid.uuid4().hex}", "host", by_host, requests=40).drop("text")


@query("""WITH x AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_name LIKE '%bolt%')
SELECT p_brand AS token, p_partkey::VARCHAR AS job_id, CASE WHEN p_size % 3 = 0 THEN 'remote' WHEN p_size % 3 = 1 THEN 'hybrid' ELSE 'unknown' END AS workplace,
CASE WHEN p_size % 3 = 0 THEN 'remote-eligible' WHEN p_size % 3 = 1 THEN 'hybrid' ELSE 'ambiguous' END AS verdict, '2024-01-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') AS posted_at FROM x""")
def board_postings(s: SparkSession, d: str) -> DataFrame:
    """Parts as the postings of a board per brand, filed as JSON, read back, filtered by title and judged."""
    place = F.when(F.col("p_size") % 3 == 1, "Hybrid, Berlin").otherwise("Berlin")
    kind = F.when(F.col("p_size") % 3 == 0, "Remote")
    job = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.struct(place.alias("location")).alias("categories"), kind.alias("workplaceType"), ((F.lit(19723) + F.col("p_size") % 28).cast("bigint") * 86_400_000).alias("createdAt"))
    p = t(s, d, "part").groupBy(F.col("p_brand").alias("token")).agg(F.to_json(F.collect_list(job)).alias("payload")).withColumn("platform", F.lit("lever"))
    return postings.matching(postings.postings(p), title="Bolt").select("token", "job_id", "workplace", boards.verdict(F.col("workplace")).alias("verdict"), "posted_at")
