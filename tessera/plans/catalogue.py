"""Queries over the star schema and the event stream, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import measure, order, panel, quality, reconcile, resolve, sparse, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def orders_q(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").withColumn("qi", C.quarter_index(F.col("o_orderdate")))


_Q = "(year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INTEGER"
_M = "sum(o_totalprice::DECIMAL(18,2))::DOUBLE"
_DAY = "ts::DATE"

# --- warehouse


@query("""
WITH s AS (SELECT n_name, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(DISTINCT l_partkey)::BIGINT AS n_parts, count(*)::BIGINT AS n_lines
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
r AS (SELECT *, rank() OVER (ORDER BY revenue DESC)::INTEGER AS rnk, 100.0::DOUBLE * revenue / (SELECT sum(revenue::DECIMAL(18,2))::DOUBLE FROM s) AS share FROM s)
SELECT *, CASE WHEN share >= 6 THEN 'Major' WHEN share >= 4 THEN 'Mid' ELSE 'Minor' END AS tier, CASE WHEN rnk <= 3 THEN 'Top 3' ELSE 'Other' END AS top FROM r""")
def nation_market_share(s: SparkSession, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(C.money("l_extendedprice").alias("rev"), F.count("*").alias("n"))
    named = lines.join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = named.groupBy("n_name").agg(C.money("rev").alias("revenue"), F.countDistinct("l_partkey").alias("n_parts"), F.sum("n").alias("n_lines"))
    # nations: a fixed few rows, so one window over all of them is bounded
    g = g.crossJoin(g.agg(C.money("revenue").alias("_all")))
    share = 100.0 * F.col("revenue") / F.col("_all")
    g = g.withColumn("rnk", F.rank().over(W.orderBy(F.desc("revenue")))).withColumn("share", share).drop("_all")
    return g.withColumn("tier", C.tier(F.col("share"), [(6, "Major"), (4, "Mid")], "Minor")).withColumn("top", F.when(F.col("rnk") <= 3, "Top 3").otherwise("Other"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS ship_date, year(l_shipdate)::INTEGER AS ship_year, l_quantity::INTEGER AS quantity,
round(l_extendedprice * (1 - l_discount), 6) AS net, l_discount >= 0.05 AS is_discounted, l_returnflag = 'R' AS is_returned FROM lineitem""")
def stg_lineitem(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_date"), F.year("l_shipdate").alias("ship_year"), F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"), (F.col("l_discount") >= 0.05).alias("is_discounted"), (F.col("l_returnflag") == "R").alias("is_returned"),
    )


@query("""WITH j AS (SELECT p_type, l_returnflag, l_quantity, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT p_type, l_returnflag, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, l_returnflag) AS r FROM j GROUP BY p_type, l_returnflag),
g AS (SELECT p_type, count(*)::BIGINT AS n_lines, count(DISTINCT l_orderkey)::BIGINT AS n_orders, (100.0::DOUBLE * sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END)) / count(*) AS pct_large FROM j GROUP BY p_type)
SELECT g.*, c.l_returnflag AS top_flag FROM g JOIN c ON g.p_type = c.p_type AND c.r = 1""")
def part_type_profile(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "lineitem").join(t(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(
        F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"), (100.0 * F.count_if(F.col("l_quantity") >= 25) / F.count("*")).alias("pct_large"),
        F.mode("l_returnflag", True).alias("top_flag"),
    )


@query(f"""SELECT md5(c_custkey::VARCHAR) AS customer_key, c_custkey, count(o_orderkey)::BIGINT AS n_orders, {_M} AS spend,
CASE WHEN coalesce({_M}, 0) >= 3000000 THEN 'Platinum' WHEN coalesce({_M}, 0) >= 1500000 THEN 'Gold' ELSE 'Silver' END AS tier, {_M} / nullif(count(o_orderkey), 0) AS avg_order
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def customer_dim(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), C.money("o_totalprice").alias("spend"))
    g = t(s, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n_orders", F.lit(0))
    return g.select(C.surrogate_key("c_custkey").alias("customer_key"), "c_custkey", n.alias("n_orders"), "spend", C.tier(F.coalesce("spend", F.lit(0.0)), [(3e6, "Platinum"), (1.5e6, "Gold")], "Silver").alias("tier"), C.safe_ratio(F.col("spend"), n).alias("avg_order"))


@query("""SELECT md5(o_orderkey::VARCHAR) AS order_key, md5(c_custkey::VARCHAR) AS customer_key, n_name, o_totalprice, o_totalprice >= 200000 AS is_large
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def fct_orders(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select(F.md5(F.col("o_orderkey").cast("string")).alias("order_key"), F.md5(F.col("c_custkey").cast("string")).alias("customer_key"), "n_name", "o_totalprice", (F.col("o_totalprice") >= 200000).alias("is_large"))


@query(f"""SELECT 'orders' AS layer, count(*)::BIGINT AS n, {_M} AS total FROM orders UNION ALL
SELECT 'lines', count(*)::BIGINT, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem UNION ALL
SELECT 'lines_without_order', count(*)::BIGINT, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey""")
def layer_totals(s: SparkSession, d: str) -> DataFrame:
    o, li = t(s, d, "orders"), t(s, d, "lineitem")
    of = lambda df, name, c: df.agg(F.count("*").alias("n"), F.coalesce(C.money(c), F.lit(0.0)).alias("total")).select(F.lit(name).alias("layer"), "n", "total")
    lost = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return of(o, "orders", "o_totalprice").unionByName(of(li, "lines", "l_extendedprice")).unionByName(of(lost, "lines_without_order", "l_extendedprice"))


@query("""WITH x AS (SELECT CASE WHEN o_totalprice >= 300000 THEN 'High' WHEN o_totalprice >= 100000 THEN 'Medium' ELSE 'Low' END AS tier FROM orders)
SELECT tier, count(*)::BIGINT AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct, CASE tier WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS place FROM x GROUP BY tier ORDER BY place""")
def tier_distribution(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "orders").groupBy(C.tier(F.col("o_totalprice"), [(3e5, "High"), (1e5, "Medium")], "Low").alias("tier")).agg(F.count("*").alias("n"))
    place = F.when(F.col("tier") == "High", 1).when(F.col("tier") == "Medium", 2).otherwise(3)
    return g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).withColumn("place", place).orderBy("place")


# --- cohorts, concentration, share


@query(f"""WITH a AS (SELECT DISTINCT o_custkey, {_Q} AS qi FROM orders), c AS (SELECT o_custkey, min(qi) AS cohort FROM a GROUP BY o_custkey HAVING min(qi) <= 7987)
SELECT cohort, count(DISTINCT a.o_custkey)::BIGINT AS size, sum(CASE WHEN qi = cohort + 1 THEN 1 ELSE 0 END)::BIGINT AS q1, sum(CASE WHEN qi = cohort + 2 THEN 1 ELSE 0 END)::BIGINT AS q2,
sum(CASE WHEN qi = cohort + 4 THEN 1 ELSE 0 END)::BIGINT AS q4 FROM a JOIN c USING (o_custkey) GROUP BY cohort""")
def cohort_retention(s: SparkSession, d: str) -> DataFrame:
    a = orders_q(s, d).select("o_custkey", "qi").distinct()
    c = a.groupBy("o_custkey").agg(F.min("qi").alias("cohort")).where("cohort <= 7987")
    later = lambda k: F.count_if(F.col("qi") == F.col("cohort") + k).alias(f"q{k}")
    return a.join(c, "o_custkey").groupBy("cohort").agg(F.countDistinct("o_custkey").alias("size"), later(1), later(2), later(4))


@query("""WITH g AS (SELECT c_custkey, c_mktsegment, r_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 0 AS active
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(c_mktsegment, 'ALL') AS segment, coalesce(r_name, 'ALL') AS region, count(*)::BIGINT AS n, count(*) FILTER (WHERE active)::BIGINT AS n_active,
(100.0::DOUBLE * count(*) FILTER (WHERE active)) / count(*) AS penetration FROM g GROUP BY GROUPING SETS ((c_mktsegment, r_name), (c_mktsegment), ())""")
def penetration_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    buyers = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_a", F.lit(1))
    g = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(buyers, "c_custkey", "left")
    g = g.groupingSets([["c_mktsegment", "r_name"], ["c_mktsegment"], []], "c_mktsegment", "r_name").agg(F.grouping("c_mktsegment").alias("_s"), F.grouping("r_name").alias("_r"), F.count("*").alias("n"), F.count("_a").alias("n_active"))
    every = lambda c, all_of: F.when(F.col(all_of) == 1, "ALL").otherwise(F.col(c))  # noqa: E731 (a null key is no total)
    return g.select(every("c_mktsegment", "_s").alias("segment"), every("r_name", "_r").alias("region"), "n", "n_active", (100.0 * F.col("n_active") / F.col("n")).alias("penetration"))


@query(f"""WITH g AS (SELECT {_Q} AS qi, c_mktsegment, {_M} AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
h AS (SELECT *, rev / sum(rev) OVER (PARTITION BY qi) AS share, row_number() OVER (PARTITION BY qi ORDER BY rev DESC, c_mktsegment) AS r FROM g)
SELECT qi, round(sum(share * share), 8) AS hhi, round(sum(share) FILTER (WHERE r <= 2), 8) AS top2, max(c_mktsegment) FILTER (WHERE r = 1) AS leader FROM h GROUP BY qi""")
def hhi_by_quarter(s: SparkSession, d: str) -> DataFrame:
    g = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("qi", "c_mktsegment").agg(C.money("o_totalprice").alias("rev"))
    w = W.partitionBy("qi")
    g = g.withColumn("share", F.col("rev") / F.sum("rev").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("rev"), "c_mktsegment")))
    return g.groupBy("qi").agg(F.round(F.sum(F.col("share") * F.col("share")), 8).alias("hhi"), F.round(F.sum(F.when(F.col("r") <= 2, F.col("share"))), 8).alias("top2"), F.max(F.when(F.col("r") == 1, F.col("c_mktsegment"))).alias("leader"))


@query(f"""WITH g AS (SELECT {_Q} AS qi, o_orderpriority AS p, {_M} AS rev FROM orders GROUP BY ALL), h AS (SELECT *, 100.0::DOUBLE * rev / sum(rev) OVER (PARTITION BY qi) AS share FROM g),
l AS (SELECT *, share - lag(share) OVER (PARTITION BY p ORDER BY qi) AS delta FROM h)
SELECT qi, p, round(delta, 8) AS delta FROM l WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, qi, p LIMIT 15""")
def share_shift_topk(s: SparkSession, d: str) -> DataFrame:
    g = orders_q(s, d).groupBy("qi", F.col("o_orderpriority").alias("p")).agg(C.money("o_totalprice").alias("rev"))
    g = g.withColumn("share", 100.0 * F.col("rev") / F.sum("rev").over(W.partitionBy("qi")))
    g = g.withColumn("delta", F.col("share") - F.lag("share").over(W.partitionBy("p").orderBy("qi"))).where("delta is not null")
    return g.orderBy(F.desc(F.abs("delta")), "qi", "p").limit(15).select("qi", "p", F.round("delta", 8).alias("delta"))


@query(f"""WITH o AS (SELECT {_Q} AS qi, o_orderpriority AS p, {_M} AS rev FROM orders GROUP BY ALL), b AS (SELECT p, avg(rev) AS m FROM o GROUP BY p)
SELECT p, arg_max(qi, struct_pack(a := abs(rev - m), q := qi)) AS worst_quarter, round(max(abs(rev - m)), 4) AS gap FROM o JOIN b USING (p) GROUP BY p""")
def worst_quarter_argmax(s: SparkSession, d: str) -> DataFrame:
    o = orders_q(s, d).groupBy("qi", F.col("o_orderpriority").alias("p")).agg(C.money("o_totalprice").alias("rev"))
    o = o.join(o.groupBy("p").agg(F.avg("rev").alias("m")), "p").withColumn("gap", F.abs(F.col("rev") - F.col("m")))
    return o.groupBy("p").agg(F.max_by("qi", F.struct("gap", "qi")).alias("worst_quarter"), F.round(F.max("gap"), 4).alias("gap"))


@query(f"""WITH c AS (SELECT c_mktsegment AS seg, c_custkey, {_M} AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY seg ORDER BY spend DESC, c_custkey)::INTEGER AS rank_high, rank() OVER (PARTITION BY seg ORDER BY spend, c_custkey)::INTEGER AS rank_low FROM c)
SELECT * FROM r WHERE rank_high <= 5 OR rank_low <= 5""")
def leaderboard_both_ends(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(C.money("o_totalprice").alias("spend"))
    c = c.join(t(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey")
    return windows.both_ends(c, "spend", ["seg"], "c_custkey", 5)


# --- event windows


def daily(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


_DAILY = f"SELECT event_type, {_DAY} AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL"


@query(f"""WITH d AS ({_DAILY}) SELECT event_type, day, n, CASE WHEN stddev_pop(n) OVER w = 0 THEN 'Infinity'::DOUBLE ELSE round((n - avg(n) OVER w) / stddev_pop(n) OVER w, 8) END AS z FROM d
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def event_daily_zscore(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).withColumn("z", F.round(windows.trailing_z("n", ["event_type"], ["day"], 28), 8))


@query(f"""WITH d AS ({_DAILY}), r AS (SELECT *, ln(n::DOUBLE) - ln(lag(n) OVER (PARTITION BY event_type ORDER BY day)::DOUBLE) AS ret FROM d),
z AS (SELECT *, (ret - avg(ret) OVER w) / greatest(stddev_pop(ret) OVER w, 0.1) AS z, count(ret) OVER w AS k FROM r WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT event_type, day, n, round(z, 6) AS z, coalesce(z > 4, false) AS spike FROM z WHERE k = 6""")
def bot_spike_returns(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("event_type").orderBy("day")
    r = daily(s, d).withColumn("ret", F.log(F.col("n").cast("double")) - F.log(F.lag("n").over(w).cast("double")))
    z = windows.trailing_z("ret", ["event_type"], ["day"], 6, floor=0.1)
    r = r.withColumn("z", z).withColumn("k", windows.trailing(F.count("ret"), ["event_type"], ["day"], 6)).where("k = 6")
    return r.select("event_type", "day", "n", F.round("z", 6).alias("z"), F.coalesce(F.col("z") > 4, F.lit(False)).alias("spike"))


@query(f"""WITH d AS ({_DAILY}), m AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS med,
 n > 1.2 * avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS flag FROM d)
SELECT event_type, day, n, coalesce(flag, false) AS flag, CASE WHEN coalesce(flag, false) THEN coalesce(med, n::DOUBLE) ELSE n::DOUBLE END AS corrected FROM m""")
def winsorized_events(s: SparkSession, d: str) -> DataFrame:
    by, order = ["event_type"], ["day"]
    x = daily(s, d).withColumn("flag", F.coalesce(F.col("n") > 1.2 * windows.trailing(F.avg("n"), by, order, 6), F.lit(False)))
    return x.withColumn("corrected", quality.winsorized("n", F.col("flag"), by, order).cast("double"))


def seen_days(s: SparkSession, d: str) -> DataFrame:
    """Users on the days on which they have events."""
    return t(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def user_days(s: SparkSession, d: str) -> DataFrame:
    """Every user on every day of the stream, with the events of the day."""
    e = seen_days(s, d)
    span = e.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return windows.dense(e.select("user_id").distinct(), span).join(e, ["user_id", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


_UD = f"""e AS (SELECT user_id, {_DAY} AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL),
g AS (SELECT u.user_id, c.day, coalesce(e.n, 0)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e) c LEFT JOIN e USING (user_id, day))"""


@query(f"""WITH {_UD}, m AS (SELECT *, avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM g)
SELECT user_id, day, n, coalesce(m > 0 AND n < 0.5 * m, false) AS cliff FROM m""")
def coverage_cliff(s: SparkSession, d: str) -> DataFrame:
    return user_days(s, d).withColumn("cliff", quality.cliff("n", ["user_id"], ["day"]))


@query(f"""WITH {_UD}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM g),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM z WHERE n = 0)
SELECT user_id, min(day) AS first, max(day) AS last, count(*)::BIGINT AS length FROM i GROUP BY user_id, run HAVING count(*) >= 2""")
def gaps_islands(s: SparkSession, d: str) -> DataFrame:
    e = seen_days(s, d)
    return sparse.gaps(e, ["user_id"], sparse.calendar(e), least=2)


@query(f"""WITH {_UD}, f AS (SELECT *, n > 0 OR (coalesce(lag(n > 0) OVER w, false) AND coalesce(lead(n > 0) OVER w, false)) AS filled FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, filled, filled AND NOT coalesce(lag(filled) OVER w, false) AS starts, filled AND NOT coalesce(lead(filled) OVER w, false) AS ends FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def presence_gap_fill(s: SparkSession, d: str) -> DataFrame:
    g = user_days(s, d).withColumn("p", F.col("n") > 0).withColumn("filled", windows.gap_fill("p", ["user_id"], ["day"]))
    w, off = W.partitionBy("user_id").orderBy("day"), F.lit(False)
    return g.select("user_id", "day", "filled", (F.col("filled") & ~F.coalesce(F.lag("filled").over(w), off)).alias("starts"), (F.col("filled") & ~F.coalesce(F.lead("filled").over(w), off)).alias("ends"))


@query(f"""WITH {_UD} SELECT user_id, day, max(n > 0) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS active,
(n > 0) OR coalesce(lag(n > 0) OVER (PARTITION BY user_id ORDER BY day), false) AS now_or_before,
coalesce(max(n > 0) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND n = 0 AND coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY day) = 0, false) AS frozen FROM g""")
def trailing_active(s: SparkSession, d: str) -> DataFrame:
    w, off = W.partitionBy("user_id").orderBy("day"), F.lit(False)
    on = F.col("n") > 0
    before = F.coalesce(F.max(on).over(w.rowsBetween(W.unboundedPreceding, -1)), off)
    return user_days(s, d).select("user_id", "day", F.max(on).over(w.rowsBetween(-11, 0)).alias("active"), (on | F.coalesce(F.lag(on).over(w), off)).alias("now_or_before"), (before & (F.col("n") == 0) & F.coalesce(F.lag("n").over(w) == 0, off)).alias("frozen"))


@query(f"""WITH {_UD}, m AS (SELECT *, n - avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS delta FROM g)
SELECT user_id, min(day) FILTER (WHERE delta >= 2) AS first_rise, min(day) FILTER (WHERE delta <= -2) AS first_fall FROM m GROUP BY user_id""")
def lead_lag_first_cross(s: SparkSession, d: str) -> DataFrame:
    """A rise or fall against the mean of the two days before can only stand on a day with events or on the two after it."""
    e = seen_days(s, d)
    x = sparse.touched(e, ["user_id"], "n", sparse.calendar(e), 2)
    x = x.withColumn("delta", F.col("n") - sparse.before("n", ["user_id"], 2) / F.when(F.col("_age") > 0, F.least("_age", F.lit(2))))
    return x.groupBy("user_id").agg(F.min(F.when(F.col("delta") >= 2, F.col("day"))).alias("first_rise"), F.min(F.when(F.col("delta") <= -2, F.col("day"))).alias("first_fall"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def latest_fact_dedup(s: SparkSession, d: str) -> DataFrame:
    return windows.latest(t(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query(f"""WITH q AS (SELECT DISTINCT (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS month_end FROM orders)
SELECT month_end, count(o_orderkey)::BIGINT AS n_visible FROM q LEFT JOIN orders ON (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE <= month_end GROUP BY month_end""")
def as_of_lag(s: SparkSession, d: str) -> DataFrame:
    """Orders visible at each month end when a month is published on the first of the next: running totals, not a range join."""
    o = t(s, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("month_end")).agg(F.count("*").alias("n"))
    seen = F.coalesce(F.sum("n").over(W.orderBy("month_end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a month
    return o.select("month_end", seen.alias("n_visible"))


@query(f"""WITH c AS (SELECT {_DAY} AS day, user_id, event_type, round(value) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT day, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS extra, sum(n - 1)::DOUBLE / sum(n)::DOUBLE AS extra_share FROM c GROUP BY day""")
def dup_day(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type", F.round("value").alias("v"))
    return quality.duplicate_share(e, ["day", "user_id", "event_type", "v"], "day")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, {_DAY} AS day FROM events), k AS (
 SELECT user_id, event_type, min(day) AS day FROM e GROUP BY ALL
 UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.day) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.day > k.day + 7) FROM k
 WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.day > k.day + 7)),
n AS (SELECT user_id, event_type, count(*)::BIGINT AS n_raw FROM events GROUP BY ALL)
SELECT user_id, event_type, n_raw, day AS kept_day FROM k JOIN n USING (user_id, event_type)""")
def relist_collapse(s: SparkSession, d: str) -> DataFrame:
    return quality.relist_collapse(t(s, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day", 7)


# --- reconciliation and estimation


@query("""WITH b AS (SELECT l_orderkey % 500 AS k, year(l_shipdate)::INTEGER AS y, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, max(l_shipdate)::DATE AS e FROM lineitem GROUP BY ALL),
o AS (SELECT k, y, 'edgar' AS source, v, e FROM b UNION ALL
 SELECT k, y, 'fmp', CASE WHEN k % 7 = 0 THEN v / 1000 WHEN k % 5 = 0 THEN v * 1.01 WHEN k % 11 = 0 THEN v * 1.1 ELSE v END, e FROM b WHERE k % 3 <> 0 UNION ALL
 SELECT k, y, 'polygon', v * 1.001, CASE WHEN k % 13 = 0 THEN e + 30 ELSE e END FROM b WHERE k % 2 = 0),
g AS (SELECT k, y, count(*) AS n, min(v) AS lo, max(v) AS hi, median(v) AS mid, max(e) - min(e) AS days, arg_min(v, CASE source WHEN 'edgar' THEN 0 WHEN 'fmp' THEN 1 ELSE 2 END) AS rv FROM o GROUP BY ALL)
SELECT k, y, n::BIGINT AS n_sources, CASE WHEN n < 2 THEN 'single_source'
 WHEN abs(hi / lo / 100 - 1) <= 0.05 OR abs(hi / lo / 1000 - 1) <= 0.05 OR abs(hi / lo / 10000 - 1) <= 0.05 OR abs(hi / lo / 1000000 - 1) <= 0.05 THEN 'unit_scale_mismatch'
 WHEN days > 20 THEN 'period_misalignment' WHEN (hi - lo) / abs(mid) * 100 <= 0.5 THEN 'agreement' WHEN (hi - lo) / abs(mid) * 100 <= 2 THEN 'minor_divergence' ELSE 'material_divergence' END AS classification, rv AS resolved_value, round(hi - lo, 4) AS spread, round(CASE WHEN n < 2 OR mid = 0 THEN 0 ELSE (hi - lo) / abs(mid) * 100 END, 8) AS disagreement_pct FROM g""")
def reconcile_sources(s: SparkSession, d: str) -> DataFrame:
    r = reconcile.reconcile(observations(s, d), ["k", "y"])
    return r.select("k", "y", "n_sources", "classification", "resolved_value", F.round("spread", 4).alias("spread"), F.round("disagreement_pct", 8).alias("disagreement_pct"))


def observations(s: SparkSession, d: str) -> DataFrame:
    """Three sources of one number for 500 keys and the years: planted scale mix-ups, shifted periods, divergences."""
    b = t(s, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("k"), F.year("l_shipdate").alias("y")).agg(C.money("l_extendedprice").alias("v"), F.to_date(F.max("l_shipdate")).alias("e"))
    k, v, e = F.col("k"), F.col("v"), F.col("e")
    second = F.when(k % 7 == 0, v / 1000).when(k % 5 == 0, v * 1.01).when(k % 11 == 0, v * 1.1).otherwise(v)
    of = lambda df, name, value, end: df.select("k", "y", F.lit(name).alias("source"), value.alias("value"), end.alias("period_end"))
    return of(b, "edgar", v, e).unionByName(of(b.where(k % 3 != 0), "fmp", second, e)).unionByName(of(b.where(k % 2 == 0), "polygon", v * 1.001, F.when(k % 13 == 0, F.date_add(e, 30)).otherwise(e)))


@query(f"""WITH c AS (SELECT c_mktsegment AS seg, {_Q} AS qi, {_M} AS rev, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT *, (rank() OVER (PARTITION BY qi ORDER BY rev) + (count(*) OVER (PARTITION BY qi, rev) - 1) / 2.0) * 100.0 / count(*) OVER (PARTITION BY qi) AS rev_pct,
 (rank() OVER (PARTITION BY qi ORDER BY n) + (count(*) OVER (PARTITION BY qi, n) - 1) / 2.0) * 100.0 / count(*) OVER (PARTITION BY qi) AS n_pct FROM c),
x AS (SELECT *, 0.45 * rev_pct::DOUBLE + 0.55 * n_pct::DOUBLE AS comp FROM p),
f AS (SELECT *, comp - (lag(comp) OVER w + lag(comp, 2) OVER w) / 2 AS delta FROM x WINDOW w AS (PARTITION BY seg ORDER BY qi))
SELECT seg, qi, round(comp, 8) AS composite, coalesce(delta >= 15 AND comp >= 55, false) AS accel, coalesce(delta <= -15 AND comp <= 45, false) AS stall FROM f""")
def pct_rank_composite(s: SparkSession, d: str) -> DataFrame:
    c = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), "qi").agg(C.money("o_totalprice").alias("rev"), F.count("*").alias("n"))
    c = c.withColumn("comp", 0.45 * windows.percentile_rank("rev", ["qi"]) + 0.55 * windows.percentile_rank("n", ["qi"]))
    c = c.withColumn("delta", F.col("comp") - windows.both_before("comp", ["seg"], ["qi"]))
    flag = lambda x: F.coalesce(x, F.lit(False))
    return c.select("seg", "qi", F.round("comp", 8).alias("composite"), flag((F.col("delta") >= 15) & (F.col("comp") >= 55)).alias("accel"), flag((F.col("delta") <= -15) & (F.col("comp") <= 45)).alias("stall"))


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, 2 * sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= sum(w) OVER (PARTITION BY l_returnflag) AS half FROM s)
SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE half GROUP BY l_returnflag""")
def weighted_median(s: SparkSession, d: str) -> DataFrame:
    return order.weighted_median(t(s, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query(f"""WITH o AS (SELECT c_mktsegment AS seg, {_Q} AS qi, {_M} AS rep FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT *, lag(rep) OVER (PARTITION BY seg ORDER BY qi) AS est FROM o), r AS (SELECT *, CASE WHEN est > 0 AND rep > 0 THEN ln(rep / est) END AS lr FROM e),
j AS (SELECT a.seg, a.qi, b.lr, row_number() OVER (PARTITION BY a.seg, a.qi ORDER BY b.qi DESC) AS k FROM r a LEFT JOIN r b ON a.seg = b.seg AND b.qi < a.qi AND b.lr IS NOT NULL)
SELECT seg, qi, round(coalesce(exp(avg(lr)), 1.0), 8) AS factor FROM j WHERE k <= 3 GROUP BY seg, qi""")
def last3_prior_ratio(s: SparkSession, d: str) -> DataFrame:
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), "qi").agg(C.money("o_totalprice").alias("rep"))
    o = o.withColumn("est", F.lag("rep").over(W.partitionBy("seg").orderBy("qi")))
    return panel.prior_ratio(o, ["seg"], "qi", "rep", "est").select("seg", "qi", F.round("factor", 8).alias("factor"))


@query(f"""WITH o AS (SELECT c_mktsegment AS seg, {_Q} AS qi, {_M} AS act FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT *, lag(act) OVER (PARTITION BY seg ORDER BY qi) AS est FROM o)
SELECT seg, count(*)::BIGINT AS n, round(avg(100 * abs(est - act) / act), 6) AS mape, round(median(100 * abs(est - act) / act), 6) AS median_ape,
 round(avg(CASE WHEN act BETWEEN 0.9 * est AND 1.1 * est THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM e WHERE est IS NOT NULL GROUP BY seg""")
def scorecard_mape(s: SparkSession, d: str) -> DataFrame:
    o = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), "qi").agg(C.money("o_totalprice").alias("act"))
    o = o.withColumn("est", F.lag("act").over(W.partitionBy("seg").orderBy("qi"))).where("est is not null").withColumn("ape", 100 * F.abs(F.col("est") - F.col("act")) / F.col("act"))
    inside = F.when(F.col("act").between(0.9 * F.col("est"), 1.1 * F.col("est")), 1.0).otherwise(0.0)
    return o.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.avg("ape"), 6).alias("mape"), F.round(F.median("ape"), 6).alias("median_ape"), F.round(F.avg(inside), 6).alias("coverage"))


@query("""WITH d AS (SELECT c_mktsegment AS seg, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT seg, rank() OVER (PARTITION BY seg ORDER BY a) + (count(*) OVER (PARTITION BY seg, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY seg ORDER BY b) + (count(*) OVER (PARTITION BY seg, b) - 1) / 2.0 AS rb FROM d)
SELECT seg, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 THEN round(corr(ra::DOUBLE, rb::DOUBLE), 6) END AS spearman FROM r GROUP BY seg""")
def spearman_by_group(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("seg"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    o = order.average_ranks(order.average_ranks(o, ["seg"], "a", "ra"), ["seg"], "b", "rb")
    return o.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman")).withColumn("spearman", F.when(F.col("n") >= 5, F.col("spearman")))


@query("""WITH x AS (SELECT DISTINCT user_id, event_type = 'purchase' AS bought FROM events), b AS (SELECT user_id, bool_or(bought) AS conv FROM x GROUP BY user_id),
u AS (SELECT user_id, count(*) AS freq FROM events GROUP BY user_id), j AS (SELECT CASE WHEN freq >= 70 THEN 'heavy' WHEN freq >= 60 THEN 'mid' ELSE 'light' END AS band, freq, conv FROM u JOIN b USING (user_id))
SELECT band, count(*)::BIGINT AS n, round(sum(CASE WHEN conv THEN freq ELSE 0 END)::DOUBLE / sum(freq)::DOUBLE, 8) AS weighted_cvr FROM j GROUP BY band""")
def weighted_cvr(s: SparkSession, d: str) -> DataFrame:
    u = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("freq"), F.bool_or(F.col("event_type") == "purchase").alias("conv"))
    u = u.withColumn("band", C.tier(F.col("freq"), [(70, "heavy"), (60, "mid")], "light"))
    return u.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("conv"), F.col("freq")).otherwise(0)) / F.sum("freq"), 8).alias("weighted_cvr"))


# --- text


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' #' || p_size::VARCHAR || ' llc'), '[^A-Z0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS flat,
CASE WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%brass%' THEN 'metal' ELSE 'other' END AS kind FROM part""")
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws("", F.col("p_name"), F.lit(" #"), F.col("p_size").cast("string"), F.lit(" llc"))
    flat = C.strip(F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", " "), r"\s+", " "))
    return t(s, d, "part").select("p_partkey", flat.alias("flat"), C.first_rule(F.col("p_type"), [("steel", "metal"), ("brass", "metal")]).alias("kind"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, coalesce(nullif(split_part(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/', 1), ''), '') AS first_step,
regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source FROM pages""")
def url_parse(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    return t(s, d, "pages").select("page_id", F.lower(F.coalesce(F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1), F.lit(""))).alias("host"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")).alias("first_step"), F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("utm_source")), F.lit("")).alias("utm_source"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS fallback FROM events""")
def props_json(s: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k bigint, missing string")
    return t(s, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("fallback"))


_HITS = ", ".join("struct_pack(n := " + " + ".join(f"(CASE WHEN contains(core, '{w}') THEN 1 ELSE 0 END)" for w in words) + f", c := '{c}')" for c, words in C.CATEGORIES)


@query(f"""WITH p AS (SELECT p_partkey, upper(p_name || ' ' || p_type) AS core FROM part), b AS (SELECT p_partkey, list_max([{_HITS}]) AS m FROM p)
SELECT p_partkey, CASE WHEN m.n > 0 THEN m.c ELSE 'Unclassified' END AS category FROM b""")
def category_keywords(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select("p_partkey", C.category(F.upper(F.concat_ws(" ", "p_name", "p_type"))).alias("category"))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 30""")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    by_hash = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")))
    return t(s, d, "documents").select("lang", "doc_id").withColumn("r", F.row_number().over(by_hash)).where("r <= 30").drop("r")


@query("""SELECT source, count(*)::BIGINT AS n_raw, count(DISTINCT md5(lower(coalesce(text, ''))))::BIGINT AS n_unique, count(DISTINCT md5(lower(coalesce(text, ''))))::DOUBLE / count(*) AS ratio,
count(*) >= 10 AND count(DISTINCT md5(lower(coalesce(text, ''))))::DOUBLE / count(*) < 0.4 AS storm FROM documents GROUP BY source""")
def repost_ratio(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n_raw"), F.countDistinct(F.md5(F.lower(F.coalesce("text", F.lit(""))))).alias("n_unique"))
    ratio = F.col("n_unique") / F.col("n_raw")
    return g.withColumn("ratio", ratio).withColumn("storm", (F.col("n_raw") >= 10) & (ratio < 0.4))


@query()
def fuzzy_resolve(s: SparkSession, d: str) -> DataFrame:
    """Part names with planted prefixes, suffixes and swaps against the distinct names."""
    p = t(s, d, "part")
    n = F.upper("p_name")
    noisy = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("SQ *"), n)).when(F.col("p_partkey") % 4 == 1, F.concat(n, F.lit(" #4821"))).when(F.col("p_partkey") % 4 == 2, F.regexp_replace(n, "^(.)(.)", "$2$1")).otherwise(n)
    raw = p.select("p_partkey", C.merchant(noisy).alias("core"))
    vendors = p.select(F.col("p_name").alias("vendor"), F.upper("p_name").alias("alias")).distinct()
    return raw.join(resolve.resolve(raw, vendors), "core", "left").select("p_partkey", "core", "method", "score", "vendor")


# --- checks and shapes


@query("""SELECT 'orders_unique' AS check_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT AS n_violations UNION ALL
SELECT 'custkey_not_null', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)::BIGINT UNION ALL
SELECT 'status_accepted', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P'))::BIGINT UNION ALL
SELECT 'customer_known', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey)::BIGINT UNION ALL
SELECT 'discount_range', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.09)::BIGINT""")
def dq_violations(s: SparkSession, d: str) -> DataFrame:
    o, li = t(s, d, "orders"), t(s, d, "lineitem")
    return quality.report([
        quality.unique(o, ["o_orderkey"], "orders_unique"), quality.not_null(o, "o_custkey", "custkey_not_null"), quality.accepted(o, "o_orderstatus", ["F", "O", "P"], "status_accepted"),
        quality.relationship(o, "o_custkey", t(s, d, "customer"), "c_custkey", "customer_known"), quality.violations(li, (F.col("l_discount") < 0) | (F.col("l_discount") > 0.09), "discount_range"),
    ]).drop("passed")


@query("""SELECT (SELECT count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey)::BIGINT AS customers_without_orders, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id))::BIGINT AS labelled,
(SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id))::BIGINT AS stray_labels""")
def anti_semi_checks(s: SparkSession, d: str) -> DataFrame:
    c, o, x, lab = (t(s, d, n) for n in ("customer", "orders", "documents", "labels"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "customers_without_orders").crossJoin(n(x.join(lab, "doc_id", "left_semi"), "labelled")).crossJoin(n(lab.join(x, "doc_id", "left_anti"), "stray_labels"))


@query(f"""WITH g AS (SELECT {_Q} AS qi, count(*)::DOUBLE AS orders, {_M} AS revenue FROM orders GROUP BY ALL) SELECT qi, kpi, value FROM g UNPIVOT (value FOR kpi IN (orders, revenue))""")
def unpivot_kpis(s: SparkSession, d: str) -> DataFrame:
    g = orders_q(s, d).groupBy("qi").agg(F.count("*").cast("double").alias("orders"), C.money("o_totalprice").alias("revenue"))
    return g.unpivot("qi", ["orders", "revenue"], "kpi", "value")


@query("""SELECT lang, count(*) FILTER (WHERE toxic = 0)::BIGINT AS toxic_0, count(*) FILTER (WHERE toxic = 1)::BIGINT AS toxic_1 FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").pivot("toxic", [0, 1]).count().fillna(0).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query(f"""SELECT CASE WHEN v < 500000 OR v IS NULL THEN '<0.5M' WHEN v < 1000000 THEN '0.5-1M' WHEN v < 3000000 THEN '1-3M' ELSE '>3M' END AS band, count(*)::BIGINT AS n
FROM (SELECT o_custkey, {_M} AS v FROM orders GROUP BY 1) GROUP BY 1""")
def level_bands(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "orders").groupBy("o_custkey").agg(C.money("o_totalprice").alias("v"))
    return g.groupBy(C.band(F.col("v"), [(0, "<0.5M"), (5e5, "0.5-1M"), (1e6, "1-3M"), (3e6, ">3M")]).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT 'FY' || (year(o_orderdate) - CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END)::VARCHAR AS fy, count(*)::BIGINT AS n, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INTEGER AS days FROM orders GROUP BY 1""")
def fiscal_labels(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "orders").groupBy(C.fiscal_label(F.col("o_orderdate")).alias("fy"))
    return g.agg(F.count("*").alias("n"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))


@query(f"""WITH g AS (SELECT n_name, {_Q} AS qi, {_M} AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, qi, round(ln(v) - ln(lag(v) OVER w), 8) AS growth, round(v / nullif(lag(v) OVER w, 0), 8) AS ratio, lead(v) OVER w AS next_v FROM g WINDOW w AS (PARTITION BY n_name ORDER BY qi)""")
def shift_lookups(s: SparkSession, d: str) -> DataFrame:
    j = orders_q(s, d).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy("n_name", "qi").agg(C.money("o_totalprice").alias("v"))
    before = F.lag("v").over(w := W.partitionBy("n_name").orderBy("qi"))
    return g.select("n_name", "qi", F.round(C.log_growth(F.col("v"), before), 8).alias("growth"), F.round(C.safe_ratio(F.col("v"), before), 8).alias("ratio"), F.lead("v").over(w).alias("next_v"))


@query(f"""SELECT user_id, coalesce(v.n, 0)::BIGINT AS views, coalesce(p.n, 0)::BIGINT AS purchases, CASE WHEN v.n IS NOT NULL AND p.n IS NOT NULL THEN 'A' ELSE 'B' END AS tier
FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) v FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1) p USING (user_id)""")
def outer_feature_merge(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    of = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    j = of(e.where("event_type = 'view'"), "v").join(of(e.where("event_type = 'purchase' and value > 50"), "p"), "user_id", "full")
    return j.select("user_id", F.coalesce("v", F.lit(0)).alias("views"), F.coalesce("p", F.lit(0)).alias("purchases"), F.when(F.col("v").isNotNull() & F.col("p").isNotNull(), "A").otherwise("B").alias("tier"))


# --- iterative and statistical: no SQL form


@query()
def greedy_match(s: SparkSession, d: str) -> DataFrame:
    """Busy days of users against the nearest days without any event, of which only those within reach are made."""
    e = seen_days(s, d)
    busy = e.where("n >= 5")
    idle = sparse.near_zeros(e, busy, ["user_id"], sparse.calendar(e), 2)
    of = lambda df: df.select("user_id", F.datediff("day", F.lit("2024-01-01")).cast("long").alias("period"))
    return resolve.greedy_match(of(busy), of(idle), ["user_id"], 2)


@query()
def logistic_drivers(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    j = j.select(F.col("quality").cast("double").alias("good"), "lang", F.log1p("n_chars").alias("size"), F.lit(1.0).alias("w"))
    return measure.logistic_drivers(j, "good ~ lang + size", "w")


# --- labels, lookups, rules


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS material, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') AS brand, coalesce(p_size / nullif(p_size % 5, 0), 0)::DOUBLE AS guarded,
floor((p_retailprice / 7) * 1000) / 1000 AS floored FROM part""")
def null_and_zero_rules(s: SparkSession, d: str) -> DataFrame:
    p, rest = t(s, d, "part"), F.col("p_size") % 5
    brand = F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("unknown"))
    return p.select("p_partkey", F.when(F.col("p_type").contains("STEEL"), "steel").otherwise("other").alias("material"), brand.alias("brand"), C.guarded_ratio(F.col("p_size").cast("double"), rest).alias("guarded"), C.floor3(F.col("p_retailprice") / 7).alias("floored"))


@query("""SELECT o_orderkey, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS label, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER AS mi, last_day(o_orderdate)::DATE AS month_end,
(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS published FROM orders""")
def calendar_scalars(s: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", C.quarter_label(o).alias("label"), C.month_index(o).alias("mi"), F.last_day(F.to_date(o)).alias("month_end"), F.add_months(F.trunc(F.to_date(o), "MM"), 1).alias("published"))


@query("""SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'ambiguous' END AS verdict, count(*)::BIGINT AS n FROM orders GROUP BY ALL""")
def lookup_map(s: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return t(s, d, "orders").groupBy("o_orderpriority", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("ambiguous")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT event_type, {_DAY} AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL), x AS (SELECT DISTINCT event_type FROM c), y AS (SELECT DISTINCT day FROM c)
SELECT x.event_type, y.day, coalesce(c.n, 0)::BIGINT AS n FROM x CROSS JOIN y LEFT JOIN c USING (event_type, day)""")
def dense_pivot(s: SparkSession, d: str) -> DataFrame:
    c = daily(s, d)
    return windows.dense(c.select("event_type").distinct(), c.select("day").distinct()).join(c, ["event_type", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""WITH d AS ({_DAILY}), b AS (SELECT event_type, day, n FROM d WHERE n > (SELECT 1.15 * avg(n) FROM d)), t AS (SELECT * FROM (SELECT 'spike' AS kind, event_type AS subject, n::VARCHAR AS detail FROM b ORDER BY n DESC, event_type, day LIMIT 10))
SELECT * FROM t UNION ALL SELECT 'busy_user', user_id::VARCHAR, count(*)::VARCHAR FROM events GROUP BY user_id HAVING count(*) >= 80""")
def anomaly_union(s: SparkSession, d: str) -> DataFrame:
    x = daily(s, d)
    top = x.crossJoin(x.agg(F.avg("n").alias("m"))).where(F.col("n") > 1.15 * F.col("m")).orderBy(F.desc("n"), "event_type", "day").limit(10)
    top = top.select(F.lit("spike").alias("kind"), F.col("event_type").alias("subject"), F.col("n").cast("string").alias("detail"))
    busy = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 80")
    return top.unionByName(busy.select(F.lit("busy_user").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.col("n").cast("string").alias("detail")))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token, p_brand FROM part), c AS (SELECT p_brand, token, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, token) AS r FROM w GROUP BY p_brand, token)
SELECT p_brand, token, n FROM c WHERE r <= 3""")
def token_attribution(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "part").select("p_brand", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"))).alias("token")).groupBy("p_brand", "token").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("n"), "token"))).where("r <= 3").drop("r")


@query("""WITH p AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[\\s\\-_]+'), lambda x: x <> '') AS w, lower(p_name) AS n FROM part)
SELECT p_partkey, round(CASE WHEN contains(n, 'red widget') THEN greatest(0.95, ((CASE WHEN list_contains(w, 'red') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(w, 'widget') THEN 1 ELSE 0 END)) / 2.0)
ELSE ((CASE WHEN list_contains(w, 'red') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(w, 'widget') THEN 1 ELSE 0 END)) / 2.0 END, 3)::DOUBLE AS score FROM p""")
def title_match(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select("p_partkey", C.title_score(F.lit("red widget"), F.col("p_name")).alias("score"))


@query(f"""WITH f AS (SELECT o_custkey, min({_Q}) AS cohort FROM orders GROUP BY 1), c AS (SELECT cohort, c_mktsegment AS seg, count(*) AS n FROM f JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT q.cohort, s.seg, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT cohort FROM c) q CROSS JOIN (SELECT DISTINCT seg FROM c) s LEFT JOIN c USING (cohort, seg)),
h AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY cohort)::DOUBLE AS share FROM g), m AS (SELECT *, avg(share) OVER (PARTITION BY seg ORDER BY cohort ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT cohort, round(sum(abs(share - before)), 8) AS distance FROM m WHERE before IS NOT NULL GROUP BY cohort""")
def composition_shift(s: SparkSession, d: str) -> DataFrame:
    f = orders_q(s, d).groupBy("o_custkey").agg(F.min("qi").alias("cohort")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = f.groupBy("cohort", F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    g = windows.dense(c.select("seg").distinct(), c.select("cohort").distinct()).join(c, ["cohort", "seg"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cohort"))).withColumn("before", windows.trailing(F.avg("share"), ["seg"], ["cohort"], 3))
    return g.where("before is not null").groupBy("cohort").agg(F.round(F.sum(F.abs(F.col("share") - F.col("before"))), 8).alias("distance"))


@query(f"""WITH p AS (SELECT c_mktsegment AS seg, o_custkey, {_Q} AS qi, sum(o_totalprice::DECIMAL(18,2)) AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT seg, qi, sum(rev)::DOUBLE AS revenue, count(*)::BIGINT AS actives FROM p GROUP BY ALL), a AS (SELECT p.seg, p.qi, count(*) AS adds FROM p LEFT JOIN p b ON p.o_custkey = b.o_custkey AND b.qi = p.qi - 1 WHERE b.qi IS NULL GROUP BY ALL),
l AS (SELECT b.seg, b.qi + 1 AS qi, count(*) AS churned FROM p b LEFT JOIN p ON p.o_custkey = b.o_custkey AND p.qi = b.qi + 1 WHERE p.qi IS NULL GROUP BY ALL)
SELECT k.seg, k.qi, 10.0 * revenue AS revenue, 10 * actives AS actives, (10 * coalesce(adds, 0))::BIGINT AS gross_adds, (10 * coalesce(churned, 0))::BIGINT AS churned, revenue / actives AS arpu FROM k LEFT JOIN a USING (seg, qi) LEFT JOIN l USING (seg, qi)""")
def panel_kpis(s: SparkSession, d: str) -> DataFrame:
    """Weighted indicators of a panel of customers (uniform weight 10): revenue, actives, gross adds, churned, revenue per active."""
    p = orders_q(s, d).groupBy("o_custkey", "qi").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"))
    w = W.partitionBy("o_custkey").orderBy("qi")
    p = p.withColumn("new", F.coalesce(F.lag("qi").over(w) != F.col("qi") - 1, F.lit(True))).withColumn("last", F.coalesce(F.lead("qi").over(w) != F.col("qi") + 1, F.lit(True)))
    p = p.join(t(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), F.col("o_custkey") == F.col("c_custkey"))
    k = p.groupBy("seg", "qi").agg(F.sum("rev").cast("double").alias("r"), F.count("*").alias("a"), F.count_if("new").alias("new"))
    gone = p.where("last").groupBy("seg", (F.col("qi") + 1).alias("qi")).agg(F.count("*").alias("gone"))
    k = k.join(gone, ["seg", "qi"], "left")
    return k.select("seg", "qi", (10.0 * F.col("r")).alias("revenue"), (10 * F.col("a")).alias("actives"), (10 * F.col("new")).alias("gross_adds"), (10 * F.coalesce("gone", F.lit(0))).alias("churned"), (F.col("r") / F.col("a")).alias("arpu"))


@query(f"""WITH e AS (SELECT user_id, {_DAY} AS day, event_type, value::DECIMAL(18,2) AS v FROM events), w AS (SELECT user_id % 10 AS g, sum(CASE WHEN day >= DATE '2024-01-15' AND day < DATE '2024-01-20' AND event_type <> 'click' THEN v ELSE 0 END)::DOUBLE AS win,
sum(CASE WHEN day < DATE '2024-01-15' AND event_type = 'click' THEN v ELSE 0 END)::DOUBLE AS slice, sum(CASE WHEN day < DATE '2024-01-15' THEN v ELSE 0 END)::DOUBLE AS base FROM e GROUP BY 1),
s AS (SELECT *, least(greatest(CASE WHEN base > 0 THEN slice / base ELSE 0.0 END, 0.0), 0.8) AS share FROM w) SELECT g, round(share, 8) AS share, round(win * share / (1 - share), 6) AS added FROM s""")
def outage_reconstruction(s: SparkSession, d: str) -> DataFrame:
    """What a slice that was dark for five days would have added, by its share of the days before, at most 0.8."""
    e = t(s, d, "events").select((F.col("user_id") % 10).alias("g"), F.to_date("ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    before, dark = F.col("day") < "2024-01-15", (F.col("day") >= "2024-01-15") & (F.col("day") < "2024-01-20")
    part = lambda c: F.sum(F.when(c, F.col("v")).otherwise(0)).cast("double")
    g = e.groupBy("g").agg(part(dark & (F.col("event_type") != "click")).alias("win"), part(before & (F.col("event_type") == "click")).alias("slice"), part(before).alias("base"))
    share = F.least(F.greatest(C.guarded_ratio(F.col("slice"), F.col("base")), F.lit(0.0)), F.lit(0.8))
    return g.select("g", F.round(share, 8).alias("share"), F.round(F.col("win") * share / (1 - share), 6).alias("added"))


@query(f"""WITH {_UD}, m AS (SELECT user_id, day, n - (lag(n) OVER w + lag(n, 2) OVER w) / 2.0 AS delta FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day)), x AS (SELECT user_id, min(day) AS d0 FROM g WHERE n >= 6 GROUP BY user_id)
SELECT x.user_id, d0, coalesce(strftime(min(m.day) FILTER (WHERE delta >= 2), '%Y-%m-%d'), 'none') AS detected, coalesce(date_diff('day', min(m.day) FILTER (WHERE delta >= 2), d0), 0)::INTEGER AS lead_days FROM x JOIN m ON x.user_id = m.user_id AND m.day BETWEEN d0 - 4 AND d0 + 4 GROUP BY x.user_id, d0""")
def event_study(s: SparkSession, d: str) -> DataFrame:
    """First rise within four days of a user's first busy day."""
    g = seen_days(s, d)
    m = sparse.touched(g, ["user_id"], "n", sparse.calendar(g), 0).withColumn("delta", F.when(F.col("_age") >= 2, F.col("n") - sparse.before("n", ["user_id"], 2) / 2)).select("user_id", "day", "delta")
    x = g.where("n >= 6").groupBy("user_id").agg(F.min("day").alias("d0"))
    near = x.join(m, "user_id").where(F.col("day").between(F.date_sub("d0", 4), F.date_add("d0", 4)))
    out = near.groupBy("user_id", "d0").agg(F.min(F.when(F.col("delta") >= 2, F.col("day"))).alias("detected"))
    return out.withColumn("lead_days", F.coalesce(F.datediff("d0", "detected"), F.lit(0))).withColumn("detected", F.coalesce(F.date_format("detected", "yyyy-MM-dd"), F.lit("none")))
