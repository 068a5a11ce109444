"""Queries of vendor signals: nations as vendors, regions as segments, jumps of revenue as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import quality
from ..operators import vendors as V
from .catalogue import query, t
from .cuts import SCORED, scored

_FIRST = 7980
SOURCES = ("jobs_pct", "web_pct", "spend_pct")
_EV = f"""{SCORED}, d AS (SELECT vendor, segment, (q - {_FIRST})::INTEGER AS quarter, jobs, web, spend, jobs_pct, web_pct, spend_pct, composite, accel, stall, CASE WHEN length(vendor) % 3 = 0 THEN 'A' WHEN length(vendor) % 3 = 1 THEN 'B' ELSE 'C' END AS tier FROM sc),
jump AS (SELECT vendor, quarter, ln(spend / lag(spend) OVER (PARTITION BY vendor ORDER BY quarter)) AS g FROM d),
ev AS (SELECT vendor, min(quarter) AS quarter, 'acceleration' AS type FROM jump WHERE g > 0.3 AND quarter >= 3 GROUP BY vendor UNION ALL SELECT vendor, min(quarter), 'stall' FROM jump WHERE g < -0.3 AND quarter >= 3 GROUP BY vendor)"""


def vendors(s: SparkSession, d: str) -> DataFrame:
    """Scored vendors with a tier, quarters from 0."""
    n = F.length("vendor") % 3
    x = scored(s, d).withColumn("quarter", (F.col("q") - _FIRST).cast("int")).withColumnsRenamed({"accel": "accel_flag", "stall": "stall_flag"})
    return x.withColumn("tier", F.when(n == 0, "A").when(n == 1, "B").otherwise("C"))


def events(x: DataFrame) -> DataFrame:
    """Each vendor's first jump and first fall of revenue."""
    w = W.partitionBy("vendor").orderBy("quarter")
    g = x.select("vendor", "quarter", F.log(F.col("spend") / F.lag("spend").over(w)).alias("g")).where("quarter >= 3 and abs(g) > 0.3")
    return g.groupBy("vendor", F.when(F.col("g") > 0, "acceleration").otherwise("stall").alias("type")).agg(F.min("quarter").alias("quarter"))


_STUDY = f"""{_EV}, lo AS (SELECT vendor, quarter AS q, source, pct FROM d UNPIVOT (pct FOR source IN (jobs_pct, web_pct, spend_pct))),
de AS (SELECT *, CASE WHEN lag(q) OVER w = q - 1 AND lag(q, 2) OVER w = q - 2 THEN pct - (lag(pct) OVER w + lag(pct, 2) OVER w) / 2 END AS delta FROM lo WINDOW w AS (PARTITION BY vendor, source ORDER BY q)),
st AS (SELECT ev.vendor, ev.quarter, ev.type, de.source, bool_or(q BETWEEN greatest(0, quarter - 4) AND least(30, quarter + 4)) AS present,
 min(q) FILTER (WHERE q BETWEEN greatest(0, quarter - 4) + 2 AND least(30, quarter + 4) AND CASE WHEN type = 'acceleration' THEN delta >= 15 ELSE delta <= -15 END) AS detected FROM ev JOIN de ON de.vendor = ev.vendor GROUP BY ALL)"""


@query(f"{_STUDY} SELECT vendor, quarter, type, source, present, detected, quarter - detected AS lead, quarter + 2 - detected AS lead_revenue FROM st")
def source_event_study(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    return V.event_study(events(x), x, SOURCES, 30)


@query(f"""{_STUDY} SELECT source, type, count(*)::BIGINT AS n_events, count(*) FILTER (WHERE present)::BIGINT AS n_present, count(*) FILTER (WHERE present AND detected IS NOT NULL)::BIGINT AS n_detected,
median(quarter - detected) FILTER (WHERE present) AS median_lead, quantile_cont(quarter - detected, 0.25) FILTER (WHERE present) AS lead_q1, quantile_cont(quarter - detected, 0.75) FILTER (WHERE present) AS lead_q3,
median(quarter + 2 - detected) FILTER (WHERE present) AS median_lead_revenue, count(*) FILTER (WHERE present AND detected IS NOT NULL)::DOUBLE / nullif(count(*) FILTER (WHERE present), 0) AS detection_rate FROM st GROUP BY source, type""")
def source_event_summary(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    return V.event_summary(V.event_study(events(x), x, SOURCES, 30))


_RANK = f"""{_EV}, fwd AS (SELECT vendor, quarter, CASE WHEN lead(quarter) OVER w = quarter + 1 THEN (lead(spend) OVER w - spend) / spend END AS growth FROM d WINDOW w AS (PARTITION BY vendor ORDER BY quarter)),
j AS (SELECT d.quarter, 'blended' AS cut, 'ALL' AS key, composite, growth FROM d JOIN fwd USING (vendor, quarter) WHERE growth IS NOT NULL UNION ALL SELECT d.quarter, 'tier', tier, composite, growth FROM d JOIN fwd USING (vendor, quarter) WHERE growth IS NOT NULL
 UNION ALL SELECT d.quarter, 'segment', segment, composite, growth FROM d JOIN fwd USING (vendor, quarter) WHERE growth IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY quarter, cut, key ORDER BY composite) + (count(*) OVER (PARTITION BY quarter, cut, key, composite) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quarter, cut, key ORDER BY growth) + (count(*) OVER (PARTITION BY quarter, cut, key, growth) - 1) / 2.0 AS b FROM j),
rq AS (SELECT quarter, cut, key, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 THEN corr(a::DOUBLE, b::DOUBLE) END AS spearman FROM r GROUP BY ALL)"""


@query(f"{_RANK} SELECT quarter, cut, key, n, round(spearman, 8) AS spearman FROM rq")
def rank_quality(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    r = V.rank_quality(x, x.select("vendor", "quarter", F.col("spend").alias("value")))
    return r.withColumn("spearman", F.round("spearman", 8))


@query(f"{_RANK} SELECT cut, key, round(median(spearman), 8) AS median_spearman, count(*)::BIGINT AS n_quarters FROM rq GROUP BY cut, key")
def rank_quality_summary(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    r = V.rank_summary(V.rank_quality(x, x.select("vendor", "quarter", F.col("spend").alias("value"))))
    return r.withColumn("median_spearman", F.round("median_spearman", 8))


_OUT = f"""{_EV}, oc AS (SELECT vendor, quarter, CASE WHEN (length(vendor) + quarter) % 11 = 0 THEN 'shutdown' WHEN (length(vendor) + quarter) % 7 = 0 THEN 'funding' END AS event FROM d)"""


def outcomes(x: DataFrame) -> DataFrame:
    k = F.length("vendor") + F.col("quarter")
    return x.select("vendor", "quarter", F.when(k % 11 == 0, "shutdown").when(k % 7 == 0, "funding").alias("event"))


@query(f"""{_OUT}, lw AS (SELECT quarter, quantile_cont(composite, 0.25) AS low FROM d GROUP BY quarter), j AS (SELECT a.composite AS c1, b.composite AS c2, lw.low FROM oc LEFT JOIN d a ON a.vendor = oc.vendor AND a.quarter = oc.quarter - 1 LEFT JOIN d b ON b.vendor = oc.vendor AND b.quarter = oc.quarter - 2 LEFT JOIN lw ON lw.quarter = b.quarter WHERE event = 'shutdown')
SELECT count(*)::BIGINT AS n_shutdowns, count(c2)::BIGINT AS n_scored, round(avg(CASE WHEN c2 IS NOT NULL THEN (c2 <= low)::INTEGER END), 8) AS bottom_quartile_share, round(median(c1), 8) AS median_before, count(*) FILTER (WHERE c1 > 50)::BIGINT AS n_above_50, round((SELECT median(composite) FROM d), 8) AS population_median FROM j""")
def shutdown_validation(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    r = V.shutdown_validation(x, outcomes(x))
    return r.select("n_shutdowns", "n_scored", F.round("bottom_quartile_share", 8).alias("bottom_quartile_share"), F.round("median_before", 8).alias("median_before"), "n_above_50", F.round("population_median", 8).alias("population_median"))


@query(f"""{_OUT} SELECT count(*)::BIGINT AS n_fundings, count(d.composite)::BIGINT AS n_scored, round(median(d.composite), 8) AS median_before, round((SELECT median(composite) FROM d), 8) AS population_median
FROM oc LEFT JOIN d ON d.vendor = oc.vendor AND d.quarter = oc.quarter - 1 WHERE event = 'funding'""")
def funding_validation(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    r = V.funding_validation(x, outcomes(x))
    return r.select("n_fundings", "n_scored", F.round("median_before", 8).alias("median_before"), F.round("population_median", 8).alias("population_median"))


_LEVEL = f"""{_EV}, lv AS (SELECT vendor, quarter, spend, CASE WHEN spend >= 4e6 THEN spend / 1000 * 4 / 0.02 WHEN jobs >= 25 THEN jobs * 12.0 * CASE WHEN segment = 'ASIA' THEN 200000.0 ELSE 220000.0 END WHEN web >= 22 THEN web * 4 * 30.0 END AS estimate,
CASE WHEN spend >= 4e6 THEN 'spend' WHEN jobs >= 25 THEN 'jobs' WHEN web >= 22 THEN 'web' ELSE 'none' END AS level_method FROM d),
lb AS (SELECT *, CASE WHEN estimate IS NULL THEN 'no_data' WHEN estimate < 1e6 THEN '<1M' WHEN estimate < 3e6 THEN '1-3M' WHEN estimate < 1e7 THEN '3-10M' WHEN estimate < 3e7 THEN '10-30M' WHEN estimate < 1e8 THEN '30-100M' ELSE '>100M' END AS level_band FROM lv)"""


def _leveled(x: DataFrame) -> DataFrame:
    x = x.select("vendor", "segment", "quarter", F.when(F.col("spend") >= 4e6, "present").otherwise("thin").alias("spend_presence"), (F.col("spend") / 1000).alias("spend_amount"), F.when(F.col("jobs") >= 25, "tracked_active").otherwise("untracked").alias("jobs_status"), F.col("jobs").alias("jobs_n"), F.when(F.col("web") >= 22, "present").otherwise("absent").alias("web_status"), F.col("web").alias("web_visits"), "spend")
    return V.levels(x, heads={"ASIA": 200_000.0})


@query(f"{_LEVEL} SELECT vendor, quarter, round(estimate, 4) AS estimate, level_band, level_method FROM lb")
def level_fallbacks(s: SparkSession, d: str) -> DataFrame:
    return _leveled(vendors(s, d)).select("vendor", "quarter", F.round("estimate", 4).alias("estimate"), "level_band", "level_method")


@query(f"""{_LEVEL}, ac AS (SELECT vendor, quarter, round(spend / 1e6, 1) * 10 AS disclosed FROM d WHERE (length(vendor) + quarter) % 9 = 0),
jn AS (SELECT ac.vendor, ac.quarter, disclosed, estimate / 1e6 AS estimate_m, level_band AS band, CASE WHEN disclosed < 1 THEN '<1M' WHEN disclosed < 3 THEN '1-3M' WHEN disclosed < 10 THEN '3-10M' WHEN disclosed < 30 THEN '10-30M' WHEN disclosed < 100 THEN '30-100M' ELSE '>100M' END AS true_band FROM ac JOIN lb ON lb.vendor = ac.vendor AND lb.quarter = ac.quarter WHERE estimate IS NOT NULL)
SELECT vendor, quarter, disclosed, round(estimate_m, 6) AS estimate_m, band, true_band, band = true_band AS band_hit, abs(list_position(['<1M', '1-3M', '3-10M', '10-30M', '30-100M', '>100M'], band) - list_position(['<1M', '1-3M', '3-10M', '10-30M', '30-100M', '>100M'], true_band)) <= 1 AS within_one,
round(abs(log10(greatest(estimate_m, 0.01)) - log10(greatest(disclosed, 0.01))), 8) AS log_error FROM jn""")
def acquisition_validation(s: SparkSession, d: str) -> DataFrame:
    x = vendors(s, d)
    disclosed = x.where((F.length("vendor") + F.col("quarter")) % 9 == 0).select("vendor", "quarter", (F.round(F.col("spend") / 1e6, 1) * 10).alias("disclosed"))
    r = V.acquisition_validation(_leveled(x), disclosed)
    return r.withColumn("estimate_m", F.round("estimate_m", 6)).withColumn("log_error", F.round("log_error", 8))


@query()
def inflection_grid(s: SparkSession, d: str) -> DataFrame:
    """Precision and recall of flags against jumps; greedy matching has no SQL form."""
    x = vendors(s, d)
    return V.inflection_grid(x, events(x))


@query("""WITH e AS (SELECT event_type AS vendor, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS month, count(*)::BIGINT AS visits FROM events GROUP BY ALL),
v AS (SELECT vendor, month, CASE WHEN month = 12 AND vendor IN ('click', 'view') THEN visits * 4 ELSE visits END AS visits FROM e), r AS (SELECT *, ln(greatest(visits, 1)::DOUBLE) - ln(greatest(lag(visits) OVER (PARTITION BY vendor ORDER BY month), 1)::DOUBLE) AS ret FROM v),
z AS (SELECT *, count(ret) OVER w = 6 AND (ret - avg(ret) OVER w) / greatest(stddev_pop(ret) OVER w, 0.1) > 4 AS hit FROM r WINDOW w AS (PARTITION BY vendor ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
o AS (SELECT 'click' AS vendor, 4 AS quarter, 0.5 AS g), s AS (SELECT z.vendor, z.month, visits, coalesce(hit, false) AND abs(coalesce(g, 0)) < 0.35 AS spike FROM z LEFT JOIN o ON o.vendor = z.vendor AND o.quarter = z.month // 3),
m AS (SELECT *, median(visits) OVER (PARTITION BY vendor ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS med FROM s)
SELECT vendor, month, visits, spike, CASE WHEN spike THEN coalesce(med, visits::DOUBLE) ELSE visits::DOUBLE END AS corrected FROM m""")
def corroborated_spikes(s: SparkSession, d: str) -> DataFrame:
    """Days as months, event types as vendors: both are visited by robots on day 12, but one moved elsewhere too."""
    e = t(s, d, "events").groupBy(F.col("event_type").alias("vendor"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("month")).agg(F.count("*").alias("visits"))
    e = e.withColumn("visits", F.when((F.col("month") == 12) & F.col("vendor").isin("click", "view"), F.col("visits") * 4).otherwise(F.col("visits")))
    others = s.range(1).select(F.lit("click").alias("vendor"), F.lit(4).alias("quarter"), F.lit(0.5).alias("moved"))
    x = V.spikes(e, others)
    return x.withColumn("corrected", quality.winsorized("visits", F.col("spike"), ["vendor"], ["month"]).cast("double"))


_BRIDGED = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' AND p_name LIKE 'red %' AND l_linenumber <> 7 THEN p_name || ' new' ELSE p_name END AS descriptor, p_name, o_custkey % 200 AS panelist, o_orderdate::DATE AS day, o_totalprice AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
hz AS (SELECT range AS h, (DATE '1995-01-01' + INTERVAL (3 * range + 3) MONTH)::DATE - 1 AS e FROM range({{quarters}})),
seen AS (SELECT h, f.*, (year(day) - 1995) * 4 + quarter(day) - 1 AS k FROM hz JOIN f ON (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE <= e),
own AS MATERIALIZED (SELECT * FROM seen WHERE descriptor NOT LIKE '% new'), nw AS MATERIALIZED (SELECT * FROM seen WHERE descriptor LIKE '% new'),
mon AS (SELECT h, p_name, date_trunc('month', day) AS m, count(*) AS n FROM own GROUP BY ALL), fade AS (SELECT h, p_name, arg_max(n, m) AS l, sum(n) AS t, count(*) AS k FROM mon GROUP BY ALL),
a AS (SELECT h, p_name AS vendor, median(amount) AS mid, date_diff('day', min(day), max(day))::DOUBLE / nullif(count(*) - 1, 0) AS cad FROM own GROUP BY ALL), b AS (SELECT h, descriptor, median(amount) AS mid, date_diff('day', min(day), max(day))::DOUBLE / nullif(count(*) - 1, 0) AS cad, count(DISTINCT panelist) AS people FROM nw GROUP BY ALL),
s AS (SELECT h, x.vendor, y.descriptor, count(*) AS n FROM (SELECT DISTINCT h, p_name AS vendor, panelist FROM own) x JOIN (SELECT DISTINCT h, descriptor, panelist FROM nw) y USING (h, panelist) GROUP BY ALL),
j AS (SELECT s.h, s.descriptor, s.vendor FROM s JOIN a USING (h, vendor) JOIN b USING (h, descriptor) JOIN fade ON fade.p_name = s.vendor AND fade.h = s.h WHERE k >= 2 AND l <= 0.7 * (t - l) / (k - 1) AND n::DOUBLE / people > 0.5 AND least(a.mid, b.mid) / greatest(a.mid, b.mid) >= 0.6 AND b.cad / a.cad BETWEEN 0.8 AND 1.25),
nm AS (SELECT h, descriptor, min(vendor) AS vendor FROM j WHERE h >= 1 GROUP BY ALL UNION ALL SELECT DISTINCT h, p_name, p_name FROM hz, f),
g AS (SELECT h, vendor, coalesce(sum(amount) FILTER (k = h), 0) AS amt, sum(amount) FILTER (k = h - 1) AS bef, count(*) FILTER (k = h) AS n0, count(*) FILTER (k >= h - 1) AS two, count(*) FILTER (k < h) AS past FROM seen JOIN nm USING (h, descriptor) WHERE k >= h - 4 GROUP BY ALL)"""


@query(_BRIDGED.format(quarters=27) + """ SELECT vendor, h::INTEGER AS quarter, round(amt, 2) AS spend_amount, n0 AS spend_count, CASE WHEN two >= 8 THEN 'present' WHEN two > 0 THEN 'thin' ELSE 'absent' END AS spend_presence,
 round(CASE WHEN two >= 8 AND amt > 0 AND bef > 0 THEN ln(amt / bef) END, 8) AS spend_growth, past > 0 AND n0 < 0.5 * past / greatest(1, least(4, h)) AS cliff FROM g""")
def spend_features(s: SparkSession, d: str) -> DataFrame:
    """Part names as descriptors, of which those of one colour are renamed for most lines from 2000 on; each quarter bridges
    and counts by what was known at its own end."""
    p = t(s, d, "part").select("p_partkey", "p_name")
    x = t(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    renamed = (F.col("o_orderdate") >= "2000-01-01") & F.col("p_name").startswith("red ") & (F.col("l_linenumber") != 7)
    feed = x.select(F.when(renamed, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("descriptor"), (F.col("o_custkey") % 200).alias("panelist"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))
    out = V.spend_features(feed, p.select(F.col("p_name").alias("descriptor"), F.col("p_name").alias("vendor")).distinct(), 27, first_year=1995)
    return out.withColumn("spend_amount", F.round("spend_amount", 2)).withColumn("spend_growth", F.round("spend_growth", 8))


@query("""WITH e AS (SELECT 'v' || (user_id % 20)::VARCHAR AS vendor, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS month, count(*)::BIGINT AS visits FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
v AS (SELECT vendor, month, CASE WHEN month = 12 AND vendor IN ('v1', 'v2', 'v3') THEN visits * 40 ELSE visits END AS visits FROM e), r AS (SELECT *, ln(greatest(visits, 1)::DOUBLE) - ln(greatest(lag(visits) OVER (PARTITION BY vendor ORDER BY month), 1)::DOUBLE) AS ret FROM v),
z AS (SELECT *, count(ret) OVER w = 6 AND (ret - avg(ret) OVER w) / greatest(stddev_pop(ret) OVER w, 0.1) > 4 AS hit FROM r WINDOW w AS (PARTITION BY vendor ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
o AS (SELECT 'v2' AS vendor, 4 AS quarter, 0.5 AS g), s AS (SELECT z.vendor, z.month, visits, coalesce(hit, false) AND abs(coalesce(g, 0)) < 0.35 AS spike FROM z LEFT JOIN o ON o.vendor = z.vendor AND o.quarter = z.month // 3),
m AS (SELECT *, median(visits) OVER (PARTITION BY vendor ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS med FROM s),
c AS (SELECT vendor, month // 3 AS quarter, CASE WHEN spike THEN coalesce(med, visits::DOUBLE) ELSE visits::DOUBLE END AS x FROM m),
q AS (SELECT vendor, quarter, sum(x) AS web_visits, count(*) AS web_months, avg(ln(greatest(x, 1.0))) AS l FROM c GROUP BY ALL),
g AS (SELECT k.vendor, n.range::INTEGER AS quarter, web_visits, web_months, l FROM (SELECT DISTINCT vendor FROM e UNION ALL SELECT 'unseen') k CROSS JOIN range(10) n LEFT JOIN q ON q.vendor = k.vendor AND q.quarter = n.range)
SELECT vendor, quarter, round(coalesce(web_visits, 0.0), 4) AS web_visits, coalesce(web_months, 0)::BIGINT AS web_months, round(l - lag(l) OVER (PARTITION BY vendor ORDER BY quarter), 8) AS web_growth FROM g""")
def web_features(s: SparkSession, d: str) -> DataFrame:
    """Days as months, groups of users as vendors, of whom three are visited by robots on day 12 and one moved elsewhere too; a
    covered vendor without traffic has its rows."""
    e = t(s, d, "events").where("user_id is not null").select(F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("vendor"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("month"))
    e = e.groupBy("vendor", "month").agg(F.count("*").alias("visits"))
    e = e.withColumn("visits", F.when((F.col("month") == 12) & F.col("vendor").isin("v1", "v2", "v3"), F.col("visits") * 40).otherwise(F.col("visits")))
    others = s.range(1).select(F.lit("v2").alias("vendor"), F.lit(4).alias("quarter"), F.lit(0.5).alias("moved"))
    out = V.web_features(e, others, e.select("vendor").union(s.range(1).select(F.lit("unseen"))), 10)
    return out.withColumn("web_visits", F.round("web_visits", 4)).withColumn("web_growth", F.round("web_growth", 8))
