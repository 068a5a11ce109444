"""Queries of the panel study: customers as panelists, order priorities as companies, order states as instruments.

The SQL rakes by a fixed number of rounds, far beyond convergence; the queries use a tolerance as tight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimators as E
from .catalogue import ORACLE, QUERIES, query, t

#: Months from January 1995 on, the outage that is planted, the quarters that count for scores.
MONTHS, OUTAGE, SCORED = 78, ("F", "1998-03-10", "1998-04-20", 12), 4


def panelists(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    joined = F.when(k % 5 == 0, 1 + k % 40).otherwise(1).cast("int")
    left = F.when(k % 7 == 0, 42 + k % 36).otherwise(0).cast("int")
    return c.select(k.alias("panelist"), (F.col("c_nationkey") % 4).cast("int").alias("age"), (k % 3).cast("int").alias("income"), F.col("r_name").alias("region"), joined.alias("joined"), left.alias("left"))


def month_of(day: Column) -> Column:
    return ((F.year(day) - 1995) * 12 + F.month(day)).cast("int")


def study(s: SparkSession, d: str) -> E.Panel:
    """The panel: purchases while members, census margins that differ from the panel's, reports of all orders."""
    who = panelists(s, d)
    day = F.to_date("o_orderdate")
    o = t(s, d, "orders").select(F.col("o_custkey").alias("panelist"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("company"), month_of(day).alias("month"), day.alias("day"), F.col("o_orderstatus").alias("instrument"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    o = o.where(F.col("month") <= MONTHS)
    inside = (F.col("joined") <= F.col("month")) & ((F.col("left") == 0) | (F.col("month") <= F.col("left")))
    txns = o.join(who.select("panelist", "joined", "left"), "panelist").where(inside).drop("joined", "left")
    dark = (F.col("instrument") == OUTAGE[0]) & F.col("day").between(OUTAGE[1], OUTAGE[2])
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    companies = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("company"), F.lit(n < "3").alias("subscription")) for n in names])))
    none = F.lit(None)
    cells = who.groupBy("age", "income").agg(F.count("*").alias("n")).select(F.lit("age_income").alias("margin"), "age", "income", none.cast("string").alias("region"), (F.col("n") * (10 + F.col("age") + 2 * F.col("income"))).alias("population"))
    sides = who.groupBy("region").agg((F.count("*") * 10).alias("population")).select(F.lit("region").alias("margin"), none.cast("int").alias("age"), none.cast("int").alias("income"), "region", "population")
    q = E.quarter_of(F.col("month"))
    reported = o.where("company is not null").groupBy("company", q.alias("quarter")).agg((F.sum("amount") * 10).cast("double").alias("revenue"), (F.count_distinct("panelist") * 10).cast("double").alias("actives"))
    reported = reported.where(F.col("quarter") < MONTHS // 3 - 1).withColumn("revenue", F.when(F.col("quarter") % 6 != 5, F.col("revenue")))
    outages = s.range(1).select(F.lit(OUTAGE[0]).alias("instrument"), F.lit(OUTAGE[1]).cast("date").alias("start"), F.lit(OUTAGE[2]).cast("date").alias("end"), F.lit(OUTAGE[3]).alias("quarter"))
    return E.Panel(txns, who, companies, cells.unionByName(sides), reported, MONTHS, outages, txns.where(~dark), 1e-14)


_DIGITS = {"revenue": 0, "actives": 4, "gross_adds": 4, "churn_rate": 8, "arpu": 2, "market_share": 7}
_IPF = 14


def _base(dark: bool) -> str:
    gone = f"AND NOT (o_orderstatus = '{OUTAGE[0]}' AND o_orderdate::DATE BETWEEN DATE '{OUTAGE[1]}' AND DATE '{OUTAGE[2]}')" if dark else ""
    return f"""
WITH p AS (SELECT c_custkey AS panelist, c_nationkey % 4 AS age, c_custkey % 3 AS income, r_name AS region, CASE WHEN c_custkey % 5 = 0 THEN 1 + c_custkey % 40 ELSE 1 END AS joined,
  CASE WHEN c_custkey % 7 = 0 THEN 42 + c_custkey % 36 ELSE 0 END AS gone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT o_custkey AS panelist, nullif(o_orderpriority, '4-NOT SPECIFIED') AS company, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS month, o_orderdate::DATE AS day, o_orderstatus AS instrument, o_totalprice::DECIMAL(18,2) AS amount, o_orderkey FROM orders),
t AS (SELECT o.* FROM o JOIN p USING (panelist) JOIN orders USING (o_orderkey) WHERE month <= {MONTHS} AND joined <= month AND (gone = 0 OR month <= gone) {gone}),
q AS (SELECT unnest(range(0, {MONTHS // 3})) AS q), co AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) AS company),
m AS MATERIALIZED (SELECT panelist, company, month, sum(amount) AS rev FROM t WHERE company IS NOT NULL GROUP BY ALL),
pc AS (SELECT DISTINCT panelist, company FROM m)"""


def _raked() -> str:
    parts = [f"""
a AS MATERIALIZED (SELECT DISTINCT p.panelist, q.q, age, income, region FROM t JOIN p USING (panelist) JOIN q ON (month - 1) // 3 IN (q.q, q.q - 1) WHERE joined <= 3 * q.q + 3 AND (gone = 0 OR gone > 3 * q.q + 3)),
n AS MATERIALIZED (SELECT q, age, income, region, count(*)::DOUBLE AS n FROM a GROUP BY ALL),
ga AS (SELECT age, income, (count(*) * (10 + age + 2 * income))::DOUBLE AS goal FROM p GROUP BY age, income), gr0 AS (SELECT region, (count(*) * 10)::DOUBLE AS goal FROM p GROUP BY region),
gr AS (SELECT region, goal * (SELECT sum(goal) FROM ga) / (SELECT sum(goal) FROM gr0) AS goal FROM gr0),
s0 AS (SELECT q.q, region, 1.0::DOUBLE AS s FROM q, gr)"""]
    for k in range(1, _IPF + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.q, n.age, n.income, any_value(goal) / sum(n * s) AS r FROM n JOIN s{k - 1} USING (q, region) JOIN ga USING (age, income) GROUP BY ALL)")
        parts.append(f"s{k} AS MATERIALIZED (SELECT n.q, n.region, any_value(goal) / sum(n * r) AS s FROM n JOIN r{k} USING (q, age, income) JOIN gr USING (region) GROUP BY ALL)")
    parts.append(f"w AS MATERIALIZED (SELECT a.panelist, a.q, r * s AS w FROM a JOIN r{_IPF} USING (q, age, income) JOIN s{_IPF} USING (q, region))")
    return ", ".join(parts)


_NAIVE = """
f AS (SELECT pc.panelist, pc.company, q.q, coalesce(sum(rev) FILTER (WHERE (month - 1) // 3 = q.q), 0)::DOUBLE AS rev, bool_or(month = 3 * q.q + 3) AS cur, bool_or(month = 3 * q.q) AS prv,
  bool_or(month BETWEEN 3 * q.q - 8 AND 3 * q.q + 3) AS trail, bool_or(month BETWEEN 3 * q.q - 11 AND 3 * q.q) AS ptrail, min(month) AS first FROM pc CROSS JOIN q JOIN m USING (panelist, company) GROUP BY ALL),
i AS (SELECT f.panelist, company, q, rev, CASE WHEN company < '3' THEN cur ELSE trail END AS act, CASE WHEN company < '3' THEN first >= 2 AND (first - 1) // 3 = q ELSE trail AND NOT ptrail AND q >= 1 END AS add,
  CASE WHEN company < '3' THEN prv AND NOT cur AND joined <= 3 * q + 3 AND (gone = 0 OR gone > 3 * q + 3) ELSE ptrail AND NOT trail END AS num,
  CASE WHEN company < '3' THEN prv AND joined <= 3 * q + 3 AND (gone = 0 OR gone > 3 * q + 3) ELSE ptrail END AS den FROM f JOIN p USING (panelist))"""
_SPELLS = f"""
g AS (SELECT pc.panelist, pc.company, mon.month, coalesce(rev, 0)::DOUBLE AS rev, m.month IS NOT NULL AS here FROM pc CROSS JOIN (SELECT unnest(range(1, {MONTHS + 1})) AS month) mon LEFT JOIN m ON m.panelist = pc.panelist AND m.company = pc.company AND m.month = mon.month),
h AS (SELECT *, here OR (coalesce(lag(here) OVER w, false) AND coalesce(lead(here) OVER w, false)) AS fil, bool_or(here) OVER (PARTITION BY panelist, company ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS trail FROM g WINDOW w AS (PARTITION BY panelist, company ORDER BY month)),
k AS (SELECT h.*, joined, gone, fil AND NOT coalesce(lag(fil) OVER w, false) AS starts, fil AND NOT coalesce(lead(fil) OVER w, false) AS ends, lag(fil, 3) OVER w AS pfil, lag(trail, 3) OVER w AS ptrail FROM h JOIN p USING (panelist) WINDOW w AS (PARTITION BY panelist, company ORDER BY month)),
i AS (SELECT panelist, company, (month - 1) // 3 AS q, sum(rev) AS rev, CASE WHEN company < '3' THEN max(fil AND month % 3 = 0) ELSE max(trail AND month % 3 = 0) END AS act,
  CASE WHEN company < '3' THEN max(starts AND month >= 2 AND joined <= month - 1) ELSE max(month % 3 = 0 AND month > 3 AND trail AND NOT coalesce(ptrail, false)) END AS add,
  CASE WHEN company < '3' THEN count(*) FILTER (WHERE ends AND month < {MONTHS} AND (gone = 0 OR gone > month + 2)) ELSE max(month % 3 = 0 AND NOT trail AND coalesce(ptrail, false))::INTEGER END AS num,
  CASE WHEN company < '3' THEN max(month % 3 = 0 AND coalesce(pfil, false)) ELSE max(month % 3 = 0 AND coalesce(ptrail, false)) END AS den FROM k GROUP BY panelist, company, (month - 1) // 3)"""
_HIDDEN = f"""
x AS (SELECT company, sum(w * CASE WHEN day >= DATE '{OUTAGE[1]}' THEN amount::DOUBLE ELSE 0 END) AS win, sum(w * CASE WHEN day < DATE '{OUTAGE[1]}' THEN amount::DOUBLE ELSE 0 END) AS pre,
  sum(w * CASE WHEN day < DATE '{OUTAGE[1]}' AND instrument = '{OUTAGE[0]}' THEN amount::DOUBLE ELSE 0 END) AS slice FROM t JOIN w ON w.panelist = t.panelist AND w.q = {OUTAGE[3]} WHERE company IS NOT NULL AND day BETWEEN DATE '1998-01-01' AND DATE '{OUTAGE[2]}' GROUP BY company),
hid AS (SELECT company, {OUTAGE[3]} AS q, win * least(slice / pre, 0.8) / (1 - least(slice / pre, 0.8)) AS hidden FROM x)"""
_CALIBRATED = f"""
rep0 AS (SELECT company, (month - 1) // 3 AS q, (10 * sum(amount))::DOUBLE AS rr, (10 * count(DISTINCT panelist))::DOUBLE AS ra FROM o WHERE month <= {MONTHS} AND company IS NOT NULL AND (month - 1) // 3 < {MONTHS // 3 - 1} GROUP BY ALL),
rep AS (SELECT company, q, CASE WHEN q % 6 <> 5 THEN rr END AS rr, ra FROM rep0),
ratio AS (SELECT e.company, e.q, CASE WHEN rr > 0 AND rev > 0 THEN ln(rr / rev) END AS lr, CASE WHEN ra > 0 AND act > 0 THEN ln(ra / act) END AS la FROM sums e LEFT JOIN rep USING (company, q)),
fr AS (SELECT company, q, coalesce(exp(avg(l)), 1.0) AS f FROM (SELECT a.company, a.q, b.lr AS l, row_number() OVER (PARTITION BY a.company, a.q ORDER BY b.q DESC) AS k FROM sums a LEFT JOIN ratio b ON a.company = b.company AND b.q < a.q AND b.lr IS NOT NULL) WHERE k <= 3 GROUP BY ALL),
fa AS (SELECT company, q, coalesce(exp(avg(l)), 1.0) AS f FROM (SELECT a.company, a.q, b.la AS l, row_number() OVER (PARTITION BY a.company, a.q ORDER BY b.q DESC) AS k FROM sums a LEFT JOIN ratio b ON a.company = b.company AND b.q < a.q AND b.la IS NOT NULL) WHERE k <= 3 GROUP BY ALL),
final AS (SELECT company, q, rev * fr.f AS rev, act * fa.f AS act, add * fa.f AS add, CASE WHEN den > 0 THEN num / den ELSE 0 END AS num, 1.0::DOUBLE AS den FROM sums JOIN fr USING (company, q) JOIN fa USING (company, q))"""


def method_sql(method: str) -> str:
    parts = [_base(method in ("m3", "m4"))]
    if method == "m1":
        parts.append("w AS (SELECT panelist, q.q, (SELECT 10.0 * count(*) FROM p) / (SELECT count(*) FROM p WHERE joined = 1) AS w FROM p, q)")
    else:
        parts.append(_raked())
    parts.append(_NAIVE if method in ("m1", "m2") else _SPELLS)
    if method in ("m3", "m4"):
        parts.append(_HIDDEN)
    hidden = " + coalesce(any_value(hidden), 0)" if method in ("m3", "m4") else ""
    join = " LEFT JOIN hid ON hid.company = co.company AND hid.q = q.q" if hidden else ""
    parts.append(f"""sums AS MATERIALIZED (SELECT co.company, q.q, coalesce(sum(w * rev), 0){hidden} AS rev, coalesce(sum(w * act::INTEGER), 0) AS act, coalesce(sum(w * add::INTEGER), 0) AS add, coalesce(sum(w * num::INTEGER), 0) AS num, coalesce(sum(w * den::INTEGER), 0) AS den
FROM co CROSS JOIN q LEFT JOIN (i JOIN w USING (panelist, q)) AS iw ON iw.company = co.company AND iw.q = q.q{join} GROUP BY ALL)""")
    if method == "m4":
        parts.append(_CALIBRATED)
    table = "final" if method == "m4" else "sums"
    r = {k: f"round({x}, {_DIGITS[k]})::DOUBLE AS {k}" for k, x in {
        "revenue": "rev", "actives": "act", "gross_adds": "add", "churn_rate": "CASE WHEN den > 0 THEN num / den ELSE 0 END", "arpu": "CASE WHEN act > 0 THEN rev / act ELSE 0 END",
        "market_share": "100.0 * rev / CASE WHEN sum(rev) OVER (PARTITION BY q) > 0 THEN sum(rev) OVER (PARTITION BY q) ELSE 1 END"}.items()}
    return ", ".join(parts) + f" SELECT company, q::INTEGER AS quarter, {', '.join(r.values())} FROM {table}"


def _wide(method: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        w = E.wide(method, study(s, d))
        return w.select("company", "quarter", *[F.round(k, n).alias(k) for k, n in _DIGITS.items()])

    return run


for _m, _name in zip(E.METHODS, ("naive", "weighted", "weighted_qa", "calibrated"), strict=True):
    QUERIES[f"estimate_{_m}_{_name}"] = _wide(_m)
    ORACLE[f"estimate_{_m}_{_name}"] = method_sql(_m)


@query(_base(False) + ", " + _raked() + " SELECT panelist, q::INTEGER AS quarter, round(w, 7) AS weight FROM w")
def rake_weights(s: SparkSession, d: str) -> DataFrame:
    """Weights of all active panelists by quarter."""
    p = study(s, d)
    return E.raked_weights(p, p.txns).select("panelist", "quarter", F.round("weight", 7).alias("weight"))


@query()
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Intervals of revenue and actives by all four methods, from 400 resampled panels."""
    return E.bootstrap(study(s, d))


@query()
def estimate_table(s: SparkSession, d: str) -> DataFrame:
    """All estimates, with intervals of revenue and actives from 400 resampled panels."""
    p = study(s, d)
    return E.estimate_table(p, SCORED, E.bootstrap(p))


def truth(p: E.Panel) -> DataFrame:
    """What all orders say, where reports are complete."""
    r = p.reported.select("company", "quarter", "revenue", "actives").where("revenue is not null")
    return r.unpivot(["company", "quarter"], ["revenue", "actives"], "kpi", "truth")


@query()
def method_scores(s: SparkSession, d: str) -> DataFrame:
    """Errors of the four methods on the quarters that have a report; quarter 12 bears the outage."""
    p = study(s, d)
    e = E.estimate_table(p, SCORED).join(truth(p).select("company", "quarter", "kpi").distinct(), ["company", "quarter", "kpi"], "left_semi")
    return E.scorecard(e, truth(p), [OUTAGE[3]])
