"""Queries of feed quality: order lines as card transactions, with planted faults that detectors must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import feeds, quality
from .catalogue import query, t
from .panelstudy import panelists

_NAMES = ("NOISE MART", "ALPHA STORE", "BRAVO SHOP", "CARGO HUB")
CONTENT = ["panelist", "day", "descriptor", "amount", "instrument"]
COLUMNS = ["txn_id", "panelist", "day", "descriptor", "amount", "instrument"]


def transactions(s: SparkSession, d: str) -> DataFrame:
    """txn_id, panelist, day, descriptor, amount, instrument of all lines; two days are fed twice, an instrument goes dark
    for six days, and a company's name changes in the middle of a month."""
    li = t(s, d, "lineitem")
    day, no = F.to_date("l_shipdate"), F.col("l_linenumber") % 4
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (no + 1).cast("int"))
    name = F.when((no == 2) & (day >= "1999-01-15"), "BRAVOS NEW PLACE").otherwise(name)
    x = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("txn_id"), F.col("l_suppkey").alias("panelist"), day.alias("day"), F.concat(name, F.lit(" #"), (F.col("l_partkey") % 9).cast("string")).alias("descriptor"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("instrument"))
    x = x.where(~((F.col("instrument") == "R") & F.col("day").between("1999-03-01", "1999-03-06")))
    again = x.where(F.col("day").isin([*map(_date, ("1997-05-05", "1998-06-07"))])).withColumn("txn_id", -1 - F.col("txn_id"))
    return x.unionByName(again)


def _date(x: str):
    import datetime

    return datetime.date.fromisoformat(x)


def companies(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.explode(F.array(*map(F.lit, _NAMES[1:]))).alias("core")).withColumn("company", F.substring_index("core", " ", 1))


def cored(s: SparkSession, d: str) -> DataFrame:
    month = (F.year("day") - 1995) * 12 + F.month("day")
    return transactions(s, d).withColumn("core", C.descriptor_core(F.col("descriptor"))).withColumn("month", month.cast("int"))


_X = """WITH x0 AS (SELECT l_orderkey * 10 + l_linenumber AS txn_id, l_suppkey AS panelist, l_shipdate::DATE AS day, CASE WHEN l_linenumber % 4 = 2 AND l_shipdate::DATE >= DATE '1999-01-15' THEN 'BRAVOS NEW PLACE'
  ELSE ['NOISE MART', 'ALPHA STORE', 'BRAVO SHOP', 'CARGO HUB'][(l_linenumber % 4 + 1)::INTEGER] END AS core, l_partkey % 9 AS no, l_extendedprice AS amount, l_returnflag AS instrument FROM lineitem),
x1 AS (SELECT * FROM x0 WHERE NOT (instrument = 'R' AND day BETWEEN DATE '1999-03-01' AND DATE '1999-03-06')),
x AS (SELECT *, core || ' #' || no::VARCHAR AS descriptor, ((year(day) - 1995) * 12 + month(day))::INTEGER AS month FROM (SELECT * FROM x1 UNION ALL SELECT -1 - txn_id, panelist, day, core, no, amount, instrument FROM x1 WHERE day IN (DATE '1997-05-05', DATE '1998-06-07')))"""
_DAYS = """g AS (SELECT day, count(*) AS n FROM x GROUP BY panelist, day, descriptor, amount, instrument),
dd AS (SELECT day, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS extra, sum(n - 1)::DOUBLE / sum(n)::DOUBLE AS extra_share FROM g GROUP BY day)"""


@query(f"""{_X}, {_DAYS} SELECT *, CASE WHEN stddev_pop(n_rows) OVER w = 0 THEN 'Infinity'::DOUBLE ELSE round((n_rows - avg(n_rows) OVER w) / stddev_pop(n_rows) OVER w, 7) END AS volume_z, extra_share > 0.2 AS doubled
FROM dd WINDOW w AS (ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def doubled_days(s: SparkSession, d: str) -> DataFrame:
    return feeds.doubled_days(transactions(s, d), CONTENT, "day").withColumn("volume_z", F.round("volume_z", 7))


@query(f"""{_X}, {_DAYS}, r AS (SELECT x.*, row_number() OVER (PARTITION BY panelist, x.day, descriptor, amount, instrument ORDER BY txn_id) AS k, extra_share > 0.2 AS bad FROM x JOIN dd USING (day))
SELECT day, count(*)::BIGINT AS n_rows, sum(amount::DECIMAL(18,2))::DOUBLE AS amount, min(txn_id) AS first_id FROM r WHERE NOT bad OR k = 1 GROUP BY day""")
def repaired_days(s: SparkSession, d: str) -> DataFrame:
    """Rows and amounts of each day once doubled days are thinned to one copy."""
    x = transactions(s, d)
    bad = feeds.doubled_days(x, CONTENT, "day").where("doubled")
    return quality.dedupe_where(x, bad, "day", CONTENT, "txn_id").groupBy("day").agg(F.count("*").alias("n_rows"), C.money("amount").alias("amount"), F.min("txn_id").alias("first_id"))


@query(f"""{_X}, days AS (SELECT DISTINCT day FROM x), ins AS (SELECT DISTINCT instrument FROM x), c AS (SELECT instrument, day, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT ins.instrument, days.day, coalesce(n, 0) AS n FROM ins CROSS JOIN days LEFT JOIN c USING (instrument, day)),
h AS (SELECT *, n = 0 AND count(*) OVER w >= 7 AND coalesce(avg(CASE WHEN n > 0 THEN n END) OVER w, 0) > 3 AS silent, row_number() OVER (PARTITION BY instrument ORDER BY day) AS rn FROM g WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY instrument ORDER BY day) AS run FROM h WHERE silent)
SELECT instrument, min(day) AS first, max(day) AS last, count(*)::BIGINT AS length FROM i GROUP BY instrument, run HAVING count(*) >= 3""")
def supplier_outages(s: SparkSession, d: str) -> DataFrame:
    """Instruments of more than three rows a day that fall silent; these tables are too small for the usual thirty."""
    return feeds.outages(transactions(s, d), "instrument", "day", watched=3)


@query("""WITH p AS (SELECT c_nationkey % 4 * 3 + c_custkey % 3 AS cell, CASE WHEN c_custkey % 5 = 0 THEN 1 + c_custkey % 40 WHEN c_custkey % 3 = 1 AND c_custkey % 7 < 3 THEN 50 ELSE 1 END AS joined, CASE WHEN c_custkey % 7 = 0 THEN 42 + c_custkey % 36 ELSE 0 END AS gone FROM customer),
mon AS (SELECT unnest(range(1, 79))::INTEGER AS month), k AS (SELECT DISTINCT cell FROM p),
a AS (SELECT mon.month, k.cell, count(*) FILTER (WHERE joined <= month AND (gone = 0 OR gone > month)) AS n, count(*) FILTER (WHERE joined = month) AS new FROM mon CROSS JOIN k JOIN p ON p.cell = k.cell GROUP BY ALL),
sh AS (SELECT *, n::DOUBLE / greatest(1, sum(n) OVER (PARTITION BY month))::DOUBLE AS share FROM a), b AS (SELECT *, avg(share) OVER (PARTITION BY cell ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM sh),
m AS (SELECT month, sum(new)::BIGINT AS joins, sum(n) AS n, coalesce(sum(abs(share - before)), 0) AS l1 FROM b GROUP BY month), j AS (SELECT month, joins, l1, joins::DOUBLE / greatest(1, coalesce(lag(n) OVER (ORDER BY month), 0))::DOUBLE AS js FROM m)
SELECT month, joins, round(js, 8) AS join_share, round(l1, 8) AS composition_l1, js > 0.05 AND l1 > 0.06 AS wave FROM j WHERE month >= 2""")
def recruitment_wave(s: SparkSession, d: str) -> DataFrame:
    """Customers as panelists, of whom many of one income join in month 50."""
    k = F.col("panelist")
    p = panelists(s, d).select((F.col("age") * 3 + F.col("income")).alias("cell"), F.when(k % 5 == 0, 1 + k % 40).when((k % 3 == 1) & (k % 7 < 3), 50).otherwise(1).cast("int").alias("joined"), "left")
    w = feeds.recruitment_waves(p, 78)
    return w.select("month", "joins", F.round("join_share", 8).alias("join_share"), F.round("composition_l1", 8).alias("composition_l1"), "wave")


@query(f"""{_X}, co AS (SELECT unnest(['ALPHA STORE', 'BRAVO SHOP', 'CARGO HUB']) AS core), mon AS (SELECT unnest(range(1, 91))::INTEGER AS month), n AS (SELECT core, month, count(*) AS n FROM x GROUP BY ALL),
v AS (SELECT co.core, mon.month, coalesce(n, 0) AS n FROM co CROSS JOIN mon LEFT JOIN n USING (core, month)),
u AS (SELECT *, avg(n) OVER (PARTITION BY core ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist, avg(n) OVER (PARTITION BY core ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS trail FROM v),
f AS (SELECT core AS old_core, min(month) AS m, arg_min(trail - n, month) AS lost FROM u WHERE month > 6 AND hist >= 20 AND trail > 0 AND n < 0.25 * trail GROUP BY core),
fs AS (SELECT core AS new_core, min(month) AS since FROM x WHERE core NOT IN (SELECT core FROM co) GROUP BY core),
pr AS (SELECT old_core, new_core, m, since FROM f JOIN fs ON since IN (m, m - 1) WHERE (SELECT count(*) FROM x WHERE core = new_core AND month = m) >= 0.3 * lost),
o AS (SELECT old_core, new_core, panelist, amount, month, month >= m - 6 AS rec FROM x JOIN pr ON core = old_core AND month < since), w AS (SELECT old_core, new_core, panelist, amount, month FROM x JOIN pr ON core = new_core AND month BETWEEN m - 1 AND m + 1),
a AS (SELECT old_core, new_core, median(amount) AS mo, count(*) FILTER (WHERE rec) AS ro, count(DISTINCT (panelist, month)) FILTER (WHERE rec) AS po FROM o GROUP BY ALL),
b AS (SELECT old_core, new_core, median(amount) AS mn, count(*) AS rn, count(DISTINCT (panelist, month)) AS pn, count(DISTINCT panelist) AS people FROM w GROUP BY ALL),
c AS (SELECT old_core, new_core, count(DISTINCT w.panelist) AS shared FROM w JOIN o USING (old_core, new_core, panelist) WHERE rec GROUP BY ALL),
e AS (SELECT old_core, new_core, split_part(old_core, ' ', 1) AS company, m AS month, abs(mn - mo) / mo AS amount_gap, coalesce(shared, 0)::DOUBLE / people AS overlap, (rn::DOUBLE / pn) / (ro::DOUBLE / po) AS cadence_ratio FROM pr JOIN a USING (old_core, new_core) JOIN b USING (old_core, new_core) LEFT JOIN c USING (old_core, new_core))
SELECT old_core, new_core, company, month, round(amount_gap, 8) AS amount_gap, round(overlap, 8) AS overlap, round(cadence_ratio, 8) AS cadence_ratio FROM e WHERE amount_gap <= 0.25 AND overlap >= 0.3 AND cadence_ratio BETWEEN 0.5 AND 2""")
def descriptor_change(s: SparkSession, d: str) -> DataFrame:
    """The renamed company is found again; twenty rows a month are enough in these small tables."""
    e = feeds.renamed(cored(s, d), companies(s), 90, monthly=20)
    return e.select("old_core", "new_core", "company", "month", *[F.round(c, 8).alias(c) for c in ("amount_gap", "overlap", "cadence_ratio")])


@query(f"""{_X} SELECT CASE core WHEN 'ALPHA STORE' THEN 'ALPHA' WHEN 'BRAVO SHOP' THEN 'BRAVO' WHEN 'BRAVOS NEW PLACE' THEN 'BRAVO' WHEN 'CARGO HUB' THEN 'CARGO' ELSE '' END AS company, year(day)::INTEGER AS year, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def company_mapping(s: SparkSession, d: str) -> DataFrame:
    """Rows by company and year under known names and a successor that was found; the rest is out of scope."""
    alias = s.range(1).select(F.lit("BRAVOS NEW PLACE").alias("new_core"), F.lit("BRAVO").alias("company"))
    m = feeds.map_companies(cored(s, d), companies(s), alias)
    return m.groupBy("company", F.year("day").alias("year")).agg(F.count("*").alias("n"))


@query(f"""{_X}, {_DAYS}, r AS (SELECT x.*, row_number() OVER (PARTITION BY panelist, x.day, descriptor, amount, instrument ORDER BY txn_id) AS k, extra_share > 0.2 AS bad FROM x JOIN dd USING (day)), fix AS (SELECT * FROM r WHERE NOT bad OR k = 1)
SELECT 'schema_columns' AS check_name, 0::BIGINT AS n_violations, true AS passed UNION ALL
SELECT 'txn_id_unique', count(*)::BIGINT, count(*) = 0 FROM (SELECT txn_id FROM x GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'content_unique_on_doubled_days', count(*)::BIGINT, count(*) = 0 FROM (SELECT 1 FROM fix WHERE bad GROUP BY panelist, day, descriptor, amount, instrument HAVING count(*) > 1) UNION ALL
SELECT 'amounts_sane', count(*)::BIGINT, count(*) = 0 FROM x WHERE NOT (amount > 0 AND amount < 50000) UNION ALL
SELECT 'days_within_calendar', count(*)::BIGINT, count(*) = 0 FROM x WHERE day NOT BETWEEN DATE '1995-01-01' AND DATE '2002-12-31' UNION ALL
SELECT 'panelists_known', count(*)::BIGINT, count(*) = 0 FROM x ANTI JOIN supplier ON panelist = s_suppkey""")
def feed_checks(s: SparkSession, d: str) -> DataFrame:
    x = transactions(s, d)
    bad = feeds.doubled_days(x, CONTENT, "day").where("doubled").select("day")
    fixed = quality.dedupe_where(x, bad, "day", CONTENT, "txn_id")
    return feeds.hard_checks(x, t(s, d, "supplier").select(F.col("s_suppkey").alias("panelist")), fixed, bad, COLUMNS, CONTENT, ("1995-01-01", "2002-12-31"), 50_000.0)


_WEEK = "date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 28"


@query(f"""WITH w AS (SELECT ({_WEEK})::INTEGER AS week, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE o_orderstatus <> 'P')::DOUBLE / count(*) AS rate FROM orders GROUP BY 1),
b AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY week) > 3 THEN avg(rate) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS before FROM w)
SELECT week, n_rows, round(rate, 8) AS rate, round(before, 8) AS before, coalesce(rate <= before - 0.03, false) AS drift FROM b""")
def weekly_drift(s: SparkSession, d: str) -> DataFrame:
    """Share of settled orders in spans of four weeks."""
    o = _weeks(s, d)
    g = feeds.weekly_drift(o, "week", "good")
    return g.select("week", "n_rows", F.round("rate", 8).alias("rate"), F.round("before", 8).alias("before"), "drift")


def _weeks(s: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 28).cast("int")
    return t(s, d, "orders").select("o_orderkey", "o_orderpriority", week.alias("week"), (F.col("o_orderstatus") != "P").alias("good"))


@query(f"""WITH w AS (SELECT ({_WEEK})::INTEGER AS week, count(*) FILTER (WHERE o_orderstatus <> 'P')::DOUBLE / count(*) AS rate FROM orders GROUP BY 1),
b AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY week) > 3 THEN avg(rate) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS before FROM w),
c AS (SELECT ({_WEEK})::INTEGER AS week, regexp_extract(upper(o_orderpriority), '^[A-Z0-9]+') AS token, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT week, token, n FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, token) AS r FROM c WHERE token <> '' AND week IN (SELECT week FROM b WHERE rate <= before - 0.03)) WHERE r <= 3""")
def drift_attribution(s: SparkSession, d: str) -> DataFrame:
    o = _weeks(s, d)
    return feeds.drift_tokens(o, feeds.weekly_drift(o, "week", "good"), "week", "o_orderpriority", "good")
