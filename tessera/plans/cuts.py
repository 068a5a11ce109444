"""Analysis cuts over reconciled, resolved and scored tables, and the joins and filters that measure what a join loses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import quality, reconcile, windows
from .catalogue import _M, _Q, ORACLE, observations, orders_q, query, t

_OBS = """b AS (SELECT l_orderkey % 500 AS k, year(l_shipdate)::INTEGER AS y, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, max(l_shipdate)::DATE AS e FROM lineitem GROUP BY ALL),
o AS (SELECT k, y, 'edgar' AS source, v, e FROM b UNION ALL
 SELECT k, y, 'fmp', CASE WHEN k % 7 = 0 THEN v / 1000 WHEN k % 5 = 0 THEN v * 1.01 WHEN k % 11 = 0 THEN v * 1.1 ELSE v END, e FROM b WHERE k % 3 <> 0 UNION ALL
 SELECT k, y, 'polygon', v * 1.001, CASE WHEN k % 13 = 0 THEN e + 30 ELSE e END FROM b WHERE k % 2 = 0)"""
_REC = f"""WITH {_OBS}, rec AS (SELECT * FROM ({ORACLE['reconcile_sources'][ORACLE['reconcile_sources'].index('g AS ('):].replace('g AS (', 'WITH g AS (', 1)}))"""


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(observations(s, d), ["k", "y"])


@query(f"WITH {_OBS} SELECT source, count(DISTINCT k)::BIGINT AS companies, count(DISTINCT y)::BIGINT AS periods, count(*)::BIGINT AS observations FROM o GROUP BY source")
def cut_coverage_by_source(s: SparkSession, d: str) -> DataFrame:
    return observations(s, d).groupBy("source").agg(F.count_distinct("k").alias("companies"), F.count_distinct("y").alias("periods"), F.count("*").alias("observations"))


@query(f"WITH {_OBS} SELECT y, count(*) FILTER (WHERE source = 'edgar')::BIGINT AS edgar, count(*) FILTER (WHERE source = 'fmp')::BIGINT AS fmp, count(*) FILTER (WHERE source = 'polygon')::BIGINT AS polygon FROM o GROUP BY y")
def cut_coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    return observations(s, d).groupBy("y").pivot("source", ["edgar", "fmp", "polygon"]).count().fillna(0)


@query(f"{_REC} SELECT k, y, n_sources, classification, round(disagreement_pct, 2) AS disagreement_pct FROM rec WHERE classification <> 'agreement' ORDER BY round(disagreement_pct, 2) DESC, k, y LIMIT 20")
def cut_disagreement_leaderboard(s: SparkSession, d: str) -> DataFrame:
    r = _reconciled(s, d).where("classification <> 'agreement'").withColumn("disagreement_pct", F.round("disagreement_pct", 2))
    return r.orderBy(F.desc("disagreement_pct"), "k", "y").limit(20).select("k", "y", "n_sources", "classification", "disagreement_pct")


@query(f"{_REC} SELECT classification, count(*)::BIGINT AS groups, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct_of_groups FROM rec GROUP BY classification")
def cut_classification_mix(s: SparkSession, d: str) -> DataFrame:
    g = _reconciled(s, d).groupBy("classification").agg(F.count("*").alias("groups"))
    return g.withColumn("pct_of_groups", F.round(100.0 * F.col("groups") / F.sum("groups").over(W.partitionBy(F.lit(1))), 1))  # a row a class


@query(f"{_REC} SELECT k, y, round(max(resolved_value) / 1e6, 3) AS value_m FROM rec WHERE y = (SELECT max(y) FROM rec) GROUP BY k, y")
def cut_latest_period(s: SparkSession, d: str) -> DataFrame:
    r = _reconciled(s, d)
    latest = r.agg(F.max("y").alias("_y"))  # one row
    return r.crossJoin(latest).where(F.col("y") == F.col("_y")).select("k", "y", F.round(F.col("resolved_value") / 1e6, 3).alias("value_m"))


@query(f"WITH {_OBS}, r AS (SELECT k, y, min(CASE source WHEN 'edgar' THEN '0edgar' WHEN 'fmp' THEN '1fmp' ELSE '1polygon' END) AS s FROM o WHERE NOT (source = 'edgar' AND k % 17 = 0) GROUP BY ALL) SELECT substr(s, 2) AS resolved_source, count(*)::BIGINT AS groups, count(*) FILTER (WHERE s[1] <> '0')::BIGINT AS without_anchor FROM r GROUP BY 1")
def cut_provenance(s: SparkSession, d: str) -> DataFrame:
    """Sources of resolved values when the regulator lacks every seventeenth company."""
    r = reconcile.reconcile(observations(s, d).where(~((F.col("source") == "edgar") & (F.col("k") % 17 == 0))), ["k", "y"])
    return r.groupBy("resolved_source").agg(F.count("*").alias("groups"), F.count_if(~F.col("regulatory_anchor")).alias("without_anchor"))


# --- resolved spend: parts as vendors, types as categories; methods by key


def _resolved(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part").select("p_partkey", "p_name", "p_type")
    k = F.col("l_partkey") % 10
    li = t(s, d, "lineitem").select("l_partkey", "l_extendedprice", F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 28).cast("int").alias("week"))
    method = F.when(k < 6, "exact").when(k < 8, "fuzzy_auto").when(k == 8, "tagger_tail").otherwise("new_vendor_candidate")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("method", method)
    return j.select("week", "method", F.when(k < 9, F.col("p_name")).otherwise("").alias("final_vendor"), F.col("p_name").alias("core"), F.when(F.col("l_partkey") % 11 > 0, F.col("p_name")).otherwise("other").alias("true_vendor"), F.col("p_type").alias("category"), F.col("l_extendedprice").alias("amount"))


_RES = """WITH r AS (SELECT date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 28 AS week, CASE WHEN l_partkey % 10 < 6 THEN 'exact' WHEN l_partkey % 10 < 8 THEN 'fuzzy_auto' WHEN l_partkey % 10 = 8 THEN 'tagger_tail' ELSE 'new_vendor_candidate' END AS method,
CASE WHEN l_partkey % 10 < 9 THEN p_name ELSE '' END AS final_vendor, p_name AS core, CASE WHEN l_partkey % 11 > 0 THEN p_name ELSE 'other' END AS true_vendor, p_type AS category, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"{_RES} SELECT final_vendor, category, count(*)::BIGINT AS txns, sum(amount)::DOUBLE AS spend, round(100.0::DOUBLE * sum(amount)::DOUBLE / (sum(sum(amount)) OVER ())::DOUBLE, 4) AS pct_of_total FROM r WHERE final_vendor <> '' GROUP BY ALL ORDER BY spend DESC, final_vendor, category LIMIT 12")
def cut_top_vendors(s: SparkSession, d: str) -> DataFrame:
    g = _resolved(s, d).where("final_vendor <> ''").groupBy("final_vendor", "category").agg(F.count("*").alias("txns"), C.money("amount").alias("spend"))
    total = g.agg(C.money("spend").alias("_all"))  # one row
    g = g.crossJoin(total).withColumn("pct_of_total", F.round(100.0 * F.col("spend") / F.col("_all"), 4)).drop("_all")
    return g.orderBy(F.desc("spend"), "final_vendor", "category").limit(12)


@query(f"""{_RES}, v AS (SELECT category, final_vendor, sum(amount) AS spend FROM r WHERE final_vendor <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY spend DESC, final_vendor) AS rk, sum(spend) OVER (PARTITION BY category) AS total FROM v)
SELECT category, round((sum(spend) FILTER (WHERE rk <= 3))::DOUBLE / max(total)::DOUBLE * 100, 6) AS top3_share_pct, max(total)::DOUBLE AS category_spend FROM k GROUP BY category""")
def cut_category_concentration(s: SparkSession, d: str) -> DataFrame:
    v = _resolved(s, d).where("final_vendor <> ''").groupBy("category", "final_vendor").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("spend"))
    k = v.withColumn("rk", F.row_number().over(W.partitionBy("category").orderBy(F.desc("spend"), "final_vendor")))
    return k.groupBy("category").agg(F.round(F.sum(F.when(F.col("rk") <= 3, F.col("spend"))).cast("double") / F.sum("spend").cast("double") * 100, 6).alias("top3_share_pct"), F.sum("spend").cast("double").alias("category_spend"))


@query(f"""{_RES}, w AS (SELECT week::INTEGER AS week, count(*)::BIGINT AS rows_total, 100.0::DOUBLE * count(*) FILTER (WHERE method IN ('exact', 'fuzzy_auto')) / count(*) AS auto_pct, count(*) FILTER (WHERE method = 'new_vendor_candidate')::BIGINT AS new_vendor_rows FROM r GROUP BY 1)
SELECT week, rows_total, round(auto_pct, 6) AS auto_match_pct, round(auto_pct - lag(auto_pct) OVER (ORDER BY week), 6) AS delta_pp, new_vendor_rows FROM w""")
def cut_weekly_mix(s: SparkSession, d: str) -> DataFrame:
    auto = 100.0 * F.count_if(F.col("method").isin("exact", "fuzzy_auto")) / F.count("*")
    w = _resolved(s, d).groupBy("week").agg(F.count("*").alias("rows_total"), auto.alias("auto_pct"), F.count_if(F.col("method") == "new_vendor_candidate").alias("new_vendor_rows"))
    delta = F.col("auto_pct") - F.lag("auto_pct").over(W.orderBy("week"))  # a row a week
    return w.select("week", "rows_total", F.round("auto_pct", 6).alias("auto_match_pct"), F.round(delta, 6).alias("delta_pp"), "new_vendor_rows")


@query(f"{_RES} SELECT core, min(week)::INTEGER AS first_seen_week, count(*)::BIGINT AS txns, sum(amount)::DOUBLE AS spend_at_stake FROM r WHERE method = 'new_vendor_candidate' GROUP BY core ORDER BY spend_at_stake DESC, core LIMIT 15")
def cut_new_vendor_queue(s: SparkSession, d: str) -> DataFrame:
    g = _resolved(s, d).where("method = 'new_vendor_candidate'").groupBy("core").agg(F.min("week").alias("first_seen_week"), F.count("*").alias("txns"), C.money("amount").alias("spend_at_stake"))
    return g.orderBy(F.desc("spend_at_stake"), "core").limit(15)


@query(f"{_RES} SELECT week::INTEGER AS week, count(*)::BIGINT AS assigned_rows, round(100.0::DOUBLE * count(*) FILTER (WHERE final_vendor = true_vendor) / count(*), 6) AS precision_pct FROM r WHERE final_vendor <> '' GROUP BY 1")
def cut_precision_by_week(s: SparkSession, d: str) -> DataFrame:
    right = 100.0 * F.count_if(F.col("final_vendor") == F.col("true_vendor")) / F.count("*")
    return _resolved(s, d).where("final_vendor <> ''").groupBy("week").agg(F.count("*").alias("assigned_rows"), F.round(right, 6).alias("precision_pct"))


# --- scored vendors: nations as vendors, regions as segments, three sources


def scored(s: SparkSession, d: str) -> DataFrame:
    """vendor, segment, q, three source percentiles, composite, delta and flags of nations by quarter."""
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = o.groupBy(F.col("n_name").alias("vendor"), F.col("r_name").alias("segment"), F.col("qi").alias("q")).agg(F.count("*").cast("double").alias("jobs"), F.count_distinct("o_custkey").cast("double").alias("web"), C.money("o_totalprice").alias("spend"))
    for c in ("jobs", "web", "spend"):
        g = g.withColumn(f"{c}_pct", windows.percentile_rank(c, ["q"]))
    g = g.withColumn("composite", 0.35 * F.col("jobs_pct") + 0.2 * F.col("web_pct") + 0.45 * F.col("spend_pct"))
    g = g.withColumn("delta", F.col("composite") - windows.both_before("composite", ["vendor"], ["q"]))
    on = lambda c: F.coalesce(c, F.lit(False))
    return g.withColumn("accel", on((F.col("delta") >= 15) & (F.col("composite") >= 55))).withColumn("stall", on((F.col("delta") <= -15) & (F.col("composite") <= 45)))


_PCT = "100.0::DOUBLE * (rank() OVER (PARTITION BY q ORDER BY {c}) + (count(*) OVER (PARTITION BY q, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY q) AS {c}_pct"
SCORED = f"""WITH g AS (SELECT n_name AS vendor, r_name AS segment, {_Q} AS q, count(*)::DOUBLE AS jobs, count(DISTINCT o_custkey)::DOUBLE AS web, {_M} AS spend FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
pp AS (SELECT *, {', '.join(_PCT.format(c=c) for c in ('jobs', 'web', 'spend'))} FROM g), cc AS (SELECT *, 0.35 * jobs_pct + 0.2 * web_pct + 0.45 * spend_pct AS composite FROM pp),
dd AS (SELECT *, composite - (lag(composite) OVER w + lag(composite, 2) OVER w) / 2 AS delta FROM cc WINDOW w AS (PARTITION BY vendor ORDER BY q)),
sc AS (SELECT *, coalesce(delta >= 15 AND composite >= 55, false) AS accel, coalesce(delta <= -15 AND composite <= 45, false) AS stall FROM dd)"""


@query(f"""{SCORED}, de AS (SELECT *, jobs_pct - avg(jobs_pct) OVER w AS jd, web_pct - avg(web_pct) OVER w AS wd, spend_pct - avg(spend_pct) OVER w AS sd FROM sc WINDOW w AS (PARTITION BY vendor ORDER BY q ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
fl AS (SELECT vendor, segment, q, CASE WHEN accel THEN 1.0 ELSE -1.0 END AS dir FROM sc WHERE accel OR stall),
fi AS (SELECT fl.vendor, fl.segment, fl.q, min(de.q) FILTER (WHERE jd * dir >= 15) AS jf, min(de.q) FILTER (WHERE wd * dir >= 15) AS wf, min(de.q) FILTER (WHERE sd * dir >= 15) AS sf FROM fl JOIN de ON de.vendor = fl.vendor AND de.q <= fl.q AND de.q >= fl.q - 4 GROUP BY ALL)
SELECT segment, CASE WHEN jf IS NOT NULL AND jf <= coalesce(wf, 99999) AND jf <= coalesce(sf, 99999) THEN 'jobs' WHEN wf IS NOT NULL AND wf <= coalesce(sf, 99999) THEN 'web' WHEN sf IS NOT NULL THEN 'spend' ELSE 'none' END AS source, count(*)::BIGINT AS n FROM fi GROUP BY ALL""")
def cut_first_cross_source(s: SparkSession, d: str) -> DataFrame:
    """Which source crossed the limit first, in the direction of each flag and up to four quarters before it."""
    x = scored(s, d)
    for c in ("jobs", "web", "spend"):
        x = x.withColumn(f"{c}_d", F.col(f"{c}_pct") - windows.trailing(F.avg(f"{c}_pct"), ["vendor"], ["q"], 2))
    flags = x.where("accel or stall").select("vendor", "segment", F.col("q").alias("flag_q"), F.when(F.col("accel"), 1.0).otherwise(-1.0).alias("direction"))
    j = flags.join(x.select("vendor", "q", "jobs_d", "web_d", "spend_d"), "vendor").where((F.col("q") <= F.col("flag_q")) & (F.col("q") >= F.col("flag_q") - 4))
    first = lambda c: F.min(F.when(F.col(f"{c}_d") * F.col("direction") >= 15, F.col("q"))).alias(c)
    j = j.groupBy("vendor", "segment", "flag_q").agg(first("jobs"), first("web"), first("spend"))
    late = lambda c: F.coalesce(F.col(c), F.lit(99999))
    source = F.when(F.col("jobs").isNotNull() & (F.col("jobs") <= F.least(late("web"), late("spend"))), "jobs").when(F.col("web").isNotNull() & (F.col("web") <= late("spend")), "web").when(F.col("spend").isNotNull(), "spend").otherwise("none")
    return j.groupBy("segment", source.alias("source")).agg(F.count("*").alias("n"))


@query(f"""{SCORED}, st AS (SELECT segment, CASE WHEN jobs >= 30 AND spend >= 3e6 THEN 'A' WHEN jobs >= 20 THEN 'B' ELSE 'C' END AS tier, jobs >= 25 AS jp, web >= 20 AS wp, spend >= 3e6 AS sp FROM sc)
SELECT 'a_tier_mix_share' AS metric, segment, tier AS key, round(count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY segment))::DOUBLE, 3) AS value FROM st GROUP BY segment, tier
UNION ALL SELECT 'b_source_present_share', segment, 'jobs', round(avg(jp::INTEGER), 3) FROM st GROUP BY segment UNION ALL SELECT 'b_source_present_share', segment, 'web', round(avg(wp::INTEGER), 3) FROM st GROUP BY segment
UNION ALL SELECT 'b_source_present_share', segment, 'spend', round(avg(sp::INTEGER), 3) FROM st GROUP BY segment""")
def cut_segments_side_by_side(s: SparkSession, d: str) -> DataFrame:
    x = scored(s, d)
    x = x.select("segment", F.when((F.col("jobs") >= 30) & (F.col("spend") >= 3e6), "A").when(F.col("jobs") >= 20, "B").otherwise("C").alias("tier"), (F.col("jobs") >= 25).alias("jobs"), (F.col("web") >= 20).alias("web"), (F.col("spend") >= 3e6).alias("spend"))
    mix = x.groupBy("segment", F.col("tier").alias("key")).agg(F.count("*").alias("n"))
    mix = mix.select(F.lit("a_tier_mix_share").alias("metric"), "segment", "key", F.round(F.col("n") / F.sum("n").over(W.partitionBy("segment")), 3).alias("value"))
    there = x.groupBy("segment").agg(*[F.round(F.avg(F.col(c).cast("int")), 3).alias(c) for c in ("jobs", "web", "spend")]).unpivot("segment", ["jobs", "web", "spend"], "key", "value")
    return mix.unionByName(there.select(F.lit("b_source_present_share").alias("metric"), "segment", "key", "value"))


# --- joins that are measured


@query("""SELECT 'clean' AS keys, count(*)::BIGINT AS n_left, count(l.doc_id)::BIGINT AS n_joined, (count(*) - count(l.doc_id))::BIGINT AS n_lost FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL
SELECT 'raw', count(*)::BIGINT, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id % 3 <> 0)::BIGINT, count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id % 3 = 0)::BIGINT FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def rows_lost(s: SparkSession, d: str) -> DataFrame:
    """What an inner join loses, before and after keys are cleaned (blanks and lower case in a third of them)."""
    k = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    left = t(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.upper(k)).alias("key"))
    right = t(s, d, "labels").select(F.upper(k).alias("key"))
    of = lambda name, a, b: quality.join_loss(a, b, "key").select(F.lit(name).alias("keys"), "n_left", "n_joined", "n_lost")
    clean = quality.clean_keys([left, right], "key")
    return of("raw", left, right).unionByName(of("clean", *clean))


@query("""WITH e AS (SELECT DISTINCT doc_id AS p FROM labels WHERE quality = 1), v AS (SELECT DISTINCT doc_id AS p FROM labels WHERE toxic = 1)
SELECT d.doc_id, d.lang, e.p IS NOT NULL AS exposed, v.p IS NOT NULL AS converted FROM documents d LEFT JOIN e ON e.p = d.doc_id LEFT JOIN v ON v.p = d.doc_id""")
def spine_join(s: SparkSession, d: str) -> DataFrame:
    """Every document with what two other frames say of it: the spine's rows all stay, once each."""
    lab = t(s, d, "labels")
    of = lambda c, name: lab.where(f"{c} = 1").select("doc_id").distinct().withColumn(name, F.lit(True))
    j = t(s, d, "documents").select("doc_id", "lang").join(of("quality", "exposed"), "doc_id", "left").join(of("toxic", "converted"), "doc_id", "left")
    return j.fillna(False, ["exposed", "converted"])


@query("""WITH c AS (SELECT n_regionkey AS g, c_nationkey, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT r_regionkey, r_name FROM region), n AS (SELECT n_nationkey, n_name FROM nation)
SELECT r_name, n_name, coalesce(c.n, 0)::BIGINT AS n FROM r CROSS JOIN n LEFT JOIN c ON c.g = r.r_regionkey AND c.c_nationkey = n.n_nationkey ORDER BY n NULLS FIRST, r_name, n_name""")
def complete_grid(s: SparkSession, d: str) -> DataFrame:
    """Customers of every region and nation, pairs without any included."""
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"))
    g = windows.dense(t(s, d, "region").select("r_regionkey", "r_name"), t(s, d, "nation").select("n_nationkey", "n_name"))
    j = g.join(c, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("c_nationkey") == F.col("n_nationkey")), "left")
    return j.select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.asc_nulls_first("n"), "r_name", "n_name")


@query(f"""WITH a AS (SELECT n_name AS v, {_Q} AS q, count(*)::BIGINT AS jobs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL),
b AS (SELECT n_name AS v, {_Q} AS q, count(*)::BIGINT AS web FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY ALL),
c AS (SELECT n_name AS v, {_Q} AS q, count(*)::BIGINT AS spend FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT v AS vendor, q AS quarter, jobs, web, spend, CASE (jobs IS NOT NULL)::INTEGER + (web IS NOT NULL)::INTEGER + (spend IS NOT NULL)::INTEGER WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS tier
FROM a FULL JOIN b USING (v, q) FULL JOIN c USING (v, q)""")
def three_feature_merge(s: SparkSession, d: str) -> DataFrame:
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("vendor"), F.col("qi").alias("quarter"), "o_orderstatus", "o_orderpriority")
    of = lambda cond, name: o.where(cond).groupBy("vendor", "quarter").agg(F.count("*").alias(name))
    j = of("o_orderstatus = 'F'", "jobs").join(of("o_orderstatus = 'P'", "web"), ["vendor", "quarter"], "full").join(of("o_orderpriority = '1-URGENT'", "spend"), ["vendor", "quarter"], "full")
    n = sum((F.col(c).isNotNull().cast("int") for c in ("jobs", "web", "spend")), F.lit(0))
    return j.withColumn("tier", F.when(n == 3, "A").when(n == 2, "B").otherwise("C"))


@query(f"""{SCORED}, fl AS (SELECT vendor, q AS flag_q, greatest(q - 4, (SELECT min(q) FROM sc)) AS lo FROM sc WHERE accel OR stall) SELECT fl.vendor, fl.flag_q, count(*)::BIGINT AS n, round(min(delta), 8) AS least, round(max(delta), 8) AS most FROM fl JOIN sc ON sc.vendor = fl.vendor AND sc.q BETWEEN fl.lo AND fl.flag_q GROUP BY ALL""")
def flag_windows(s: SparkSession, d: str) -> DataFrame:
    """Deltas between a flag's own lower bound and the flag: an equi join with a range by row."""
    x = scored(s, d)
    first = x.agg(F.min("q").alias("_first"))  # one row
    fl = x.where("accel or stall").select("vendor", F.col("q").alias("flag_q")).crossJoin(first).withColumn("lo", F.greatest(F.col("flag_q") - 4, "_first"))
    j = fl.join(x.select("vendor", "q", "delta"), "vendor").where(F.col("q").between(F.col("lo"), F.col("flag_q")))
    return j.groupBy("vendor", "flag_q").agg(F.count("*").alias("n"), F.round(F.min("delta"), 8).alias("least"), F.round(F.max("delta"), 8).alias("most"))


@query(f"""WITH f AS (SELECT n_name, {_Q} AS qi, {_M} AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), l AS (SELECT n_name, min(qi) + 4 AS lo FROM f GROUP BY 1)
SELECT n_name, count(*)::BIGINT AS n, round(sum(v::DECIMAL(18,2))::DOUBLE, 2) AS v FROM f JOIN l USING (n_name) WHERE qi BETWEEN lo AND 7999 AND n_name NOT IN ('CHINA', 'PERU') GROUP BY 1""")
def bounded_by_own_start(s: SparkSession, d: str) -> DataFrame:
    """Quarters from a year after each nation's own first on: the correlated bound is computed once a nation."""
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = o.groupBy("n_name", "qi").agg(C.money("o_totalprice").alias("v"))
    f = f.withColumn("lo", F.min("qi").over(W.partitionBy("n_name")) + 4).where(F.col("qi").between(F.col("lo"), 7999) & ~F.col("n_name").isin("CHINA", "PERU"))
    return f.groupBy("n_name").agg(F.count("*").alias("n"), F.round(C.money("v"), 2).alias("v"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' ELSE coalesce(nullif(trim(lang, ' '), ''), 'unknown') END AS lang FROM documents""")
def blank_defaults(s: SparkSession, d: str) -> DataFrame:
    lang = C.blank_default(F.col("lang"), "unknown")
    return t(s, d, "documents").select("doc_id", F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").otherwise(lang).alias("lang"))


_LAYERS = f"orders_total AS (SELECT {_M} AS v FROM orders), by_quarter AS (SELECT sum(v::DECIMAL(18,2))::DOUBLE AS v FROM (SELECT {_Q} AS q, {_M} AS v FROM orders GROUP BY 1))"


@query(f"WITH {_LAYERS} SELECT 'by_quarter' AS layer, by_quarter.v AS total, orders_total.v AS expected FROM by_quarter, orders_total WHERE by_quarter.v <> orders_total.v UNION ALL SELECT 'known_customers', (SELECT {_M} FROM orders SEMI JOIN customer ON o_custkey = c_custkey AND c_custkey % 50 <> 1), orders_total.v FROM orders_total")
def layer_mismatches(s: SparkSession, d: str) -> DataFrame:
    """Totals of layers that differ from the base's; a layer that drops some customers must show."""
    o = t(s, d, "orders")
    total = lambda df, c: df.agg(C.money(c).alias("total"))
    known = t(s, d, "customer").where("c_custkey % 50 <> 1")
    layers = total(orders_q(s, d).groupBy("qi").agg(C.money("o_totalprice").alias("v")), "v").withColumn("layer", F.lit("by_quarter"))
    layers = layers.unionByName(total(o.join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), "o_totalprice").withColumn("layer", F.lit("known_customers")))
    return layers.crossJoin(total(o, "o_totalprice").withColumnRenamed("total", "expected")).where("total <> expected").select("layer", "total", "expected")


@query("""SELECT m AS month, (year(m) * 12 + month(m) - 1)::INTEGER AS mi, (year(m) * 4 + quarter(m) - 1)::INTEGER AS qi, year(m)::VARCHAR || 'Q' || quarter(m)::VARCHAR AS label, day(last_day(m))::INTEGER AS days, last_day(m) AS month_end, date_trunc('quarter', m)::DATE AS quarter_start,
(date_trunc('quarter', m) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, (m + INTERVAL 1 MONTH)::DATE AS published FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH))::DATE AS m FROM orders)""")
def calendar_frame(s: SparkSession, d: str) -> DataFrame:
    """All months of the orders."""
    first, last = t(s, d, "orders").agg(F.min("o_orderdate").cast("string"), F.max("o_orderdate").cast("string")).first()
    return C.calendar(s, first[:10], last[:10])


@query("""WITH o AS (SELECT o_custkey, min(year(o_orderdate)) AS f, max(year(o_orderdate)) AS l FROM orders GROUP BY 1), n AS (SELECT n_name, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT c_mktsegment, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'timeline_not_inverted' AS check_name, count(*) FILTER (WHERE f > l OR l - f < 0)::BIGINT AS n_violations, count(*) FILTER (WHERE f > l OR l - f < 0) = 0 AS passed FROM o
UNION ALL SELECT 'features_in_range', count(*)::BIGINT, count(*) = 0 FROM lineitem WHERE l_discount < 0 OR l_discount > 1 OR l_tax < 0 OR l_tax > 1 OR l_quantity < 1 OR l_quantity > 50
UNION ALL SELECT 'fact_has_keys', count(*)::BIGINT, count(*) = 0 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IS NULL OR n_name IS NULL OR n_name = ''
UNION ALL SELECT 'nation_shares_sum', (CASE WHEN abs((SELECT sum(100 * rev / (SELECT sum(rev) FROM n)) FROM n) - 100) > 0.5 THEN 1 ELSE 0 END)::BIGINT, abs((SELECT sum(100 * rev / (SELECT sum(rev) FROM n)) FROM n) - 100) <= 0.5
UNION ALL SELECT 'segment_shares_sum', (CASE WHEN abs((SELECT sum(100 * rev / (SELECT sum(rev) FROM s)) FROM s) - 100) > 0.5 THEN 1 ELSE 0 END)::BIGINT, abs((SELECT sum(100 * rev / (SELECT sum(rev) FROM s)) FROM s) - 100) <= 0.5
UNION ALL SELECT 'nothing_negative', count(*)::BIGINT, count(*) = 0 FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'size_in_scale', count(*)::BIGINT, count(*) = 0 FROM part WHERE p_size < 0 OR p_size > 40
UNION ALL SELECT 'dates_in_range', count(*)::BIGINT, count(*) = 0 FROM orders WHERE year(o_orderdate) < 1995 OR year(o_orderdate) > 2000
UNION ALL SELECT 'totals_agree', (CASE WHEN (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders) <> (SELECT sum(rev::DECIMAL(18,2))::DOUBLE FROM s) THEN 1 ELSE 0 END)::BIGINT, (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders) = (SELECT sum(rev::DECIMAL(18,2))::DOUBLE FROM s)
UNION ALL SELECT 'delay_reasonable', count(*)::BIGINT, count(*) = 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) NOT BETWEEN -4000 AND 100""")
def singular_checks(s: SparkSession, d: str) -> DataFrame:
    """One check of each kind: timelines, ranges of features, keys of facts, shares that sum to 100 (two), signs, scales,
    dates, totals of layers, delays; some of them must fail on these tables."""
    o, li, c, n = (t(s, d, x) for x in ("orders", "lineitem", "customer", "nation"))
    years = o.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("f"), F.max(F.year("o_orderdate")).alias("l"))
    nations = li.groupBy("l_suppkey").agg(C.money("l_extendedprice").alias("r")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(C.money("r").alias("rev"))
    segments = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(C.money("o_totalprice").alias("rev"))
    shares = lambda g: g.crossJoin(g.agg(F.sum("rev").alias("_all"))).agg(F.sum(100 * F.col("rev") / F.col("_all")).alias("total")).where("abs(total - 100) > 0.5")
    keys = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    layers = o.agg(C.money("o_totalprice").alias("a")).crossJoin(segments.agg(C.money("rev").alias("b"))).where("a <> b")
    late = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(True)
    return quality.report([
        quality.violations(years, (F.col("f") > F.col("l")) | (F.col("l") - F.col("f") < 0), "timeline_not_inverted"),
        quality.violations(li, ~(F.col("l_discount").between(0, 1) & F.col("l_tax").between(0, 1) & F.col("l_quantity").between(1, 50)), "features_in_range"),
        quality.violations(keys, F.col("c_custkey").isNull() | F.col("n_name").isNull() | (F.col("n_name") == ""), "fact_has_keys"),
        quality.violations(shares(nations), none, "nation_shares_sum"), quality.violations(shares(segments), none, "segment_shares_sum"), quality.violations(o, F.col("o_totalprice") < 0, "nothing_negative"),
        quality.violations(t(s, d, "part"), ~F.col("p_size").between(0, 40), "size_in_scale"), quality.violations(o, ~F.year("o_orderdate").between(1995, 2000), "dates_in_range"),
        quality.violations(layers, none, "totals_agree"), quality.violations(late, ~F.datediff("l_shipdate", "o_orderdate").between(-4000, 100), "delay_reasonable"),
    ])
