"""A simulated consumer market and the panel that watches it: people, subscriptions, purchases, recruitment, faults, truth.

Everything is drawn from hashes of keys, so a world is a pure function of its size and seed: equal on every retry and at
any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.estimators import Panel, quarter_of
from .draws import by_code, choice, normal, poisson, uniform

#: Shares of ages by income, and of regions.
CELLS = (6, 8, 5, 7, 10, 9, 8, 11, 10, 9, 9, 8)
REGIONS = (("East", 3), ("North", 2), ("South", 3), ("West", 2))
#: name, descriptor, price, adoption and loss a month, growth of adoption over the run, multipliers of adoption by age.
SUBSCRIPTIONS = (("Lumen", "LUMEN TV", 12.99, 0.020, 0.030, 1.5, (1.4, 1.2, 0.8, 0.5)), ("Cadenza", "CADENZA MUSIC", 9.99, 0.025, 0.035, 1.0, (1.6, 1.2, 0.7, 0.4)), ("Larder", "LARDER BOX", 49.0, 0.006, 0.060, 0.8, (0.8, 1.3, 1.1, 0.6)))
#: name, descriptor, share of people who ever buy, purchases a month of those, log-mean and log-deviation of amounts.
SHOPS = (("Verge", "VERGE MARKET", 0.5, 0.50, 3.4, 0.6), ("Quill", "QUILL BOOKS", 0.3, 0.30, 2.9, 0.5))
NOISE = ("CORNER FUEL", 0.6, 3.2, 0.5)
INSTRUMENTS = ("card_a", "card_b", "card_c", "wallet")
POPULAR, ENROLLED = (4, 3, 2, 2), (0.85, 0.85, 0.85, 0.6)
#: Weights of recruitment by age and income, at the start and in the wave; monthly loss of panelists by age.
START_AGE, START_INCOME, WAVE_AGE, WAVE_INCOME = (1.6, 1.2, 0.8, 0.4), (0.6, 1.0, 1.5), (3.0, 1.0, 0.4, 0.2), (2.0, 1.0, 0.5)
GONE = (0.020, 0.014, 0.010, 0.008)
#: Months before the first in which the market settles, and within which a lapsed customer comes back more easily.
BEFORE, WINBACK = 18, 6


@dataclass(frozen=True)
class World:
    """Size, seed and the faults of a world."""

    people: int = 200_000
    months: int = 36
    panel: int = 6000
    wave: tuple[int, int] = (16, 1500)  # month and size
    price_rise: tuple[str, int, float, float] = ("Lumen", 20, 15.99, 2.0)  # name, month, price, loss multiplier for three months
    renamed: tuple[str, str, str] = ("Verge", "2024-05-14", "VG SHOP ONLINE")
    outage: tuple[str, str, str] = ("card_b", "2024-02-05", "2024-02-16")
    doubled: str = "2023-08-14"
    seed: int = 11


def day_of(month: Column, day: Column | int) -> Column:
    """The date of a day in a month that counts from January 2022; days behind a month's end are its last."""
    first = F.add_months(F.lit("2022-01-01").cast("date"), month.cast("int") - 1)
    return F.least(F.date_add(first, (F.lit(day) if isinstance(day, int) else day).cast("int") - 1), F.last_day(first))


def population(s: SparkSession, w: World) -> DataFrame:
    """person, age, income, region, frailty (a log-normal factor of mean one)."""
    p = s.range(w.people).withColumnRenamed("id", "person")
    cell = choice(uniform(w.seed, "person", 1), CELLS)
    region = F.element_at(F.array(*[F.lit(n) for n, _ in REGIONS]), choice(uniform(w.seed, "person", 2), [x for _, x in REGIONS]) + 1)
    p = p.withColumn("_c", cell)
    return p.select("person", F.floor(F.col("_c") / 3).cast("int").alias("age"), (F.col("_c") % 3).cast("int").alias("income"), region.alias("region"), F.exp(0.5 * normal(w.seed, "person", 3) - 0.125).alias("frailty"))


def census(people: DataFrame) -> DataFrame:
    """Margins of the population: age by income, and region; the joint of all three is not published."""
    none = F.lit(None)
    a = people.groupBy("age", "income").agg(F.count("*").alias("population")).select(F.lit("age_income").alias("margin"), "age", "income", none.cast("string").alias("region"), "population")
    return a.unionByName(people.groupBy("region").agg(F.count("*").alias("population")).select(F.lit("region").alias("margin"), none.cast("int").alias("age"), none.cast("int").alias("income"), "region", "population"))


def _uniforms(person: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers between 0 and 1 by person: the same kind of draw as in DataFrame code, for what is simulated in batches."""
    with np.errstate(over="ignore"):
        x = person.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in salts:
            x = (x ^ np.uint64(k + 0x1234567)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def subscriptions(people: DataFrame, w: World) -> DataFrame:
    """person, company, month, adopted, lost (at its end) of every month from 0 on in which a person pays; month 0 gives the
    state before the first.

    A month depends on the one before it, by tenure and time since a lapse, so people go through the months in batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            who, age, frailty = pdf["person"].to_numpy(), pdf["age"].to_numpy(), pdf["frailty"].to_numpy()
            for i, (name, _, _, adopt, lose, growth, by_age) in enumerate(SUBSCRIPTIONS):
                on, tenure, lapsed = np.zeros(len(who), bool), np.zeros(len(who), int), np.full(len(who), -1000)
                likely = adopt * np.array(by_age)[age] * frailty
                rows = []
                for m in range(1 - BEFORE, w.months + 1):
                    trend = 1 + (growth - 1) * max(m, 0) / w.months
                    new = ~on & (_uniforms(who, w.seed, i, m + 100, 4) < np.minimum(0.5, likely * trend * np.where(m - lapsed <= WINBACK, 2.0, 1.0)))
                    on |= new
                    tenure = np.where(new, 1, tenure)
                    rise = w.price_rise[3] if name == w.price_rise[0] and 0 <= m - w.price_rise[1] <= 2 else 1.0
                    gone = on & (_uniforms(who, w.seed, i, m + 100, 5) < np.minimum(0.9, lose * rise * np.where(tenure <= 2, 1.6, np.where(tenure >= 12, 0.6, 1.0))))
                    if m >= 0:
                        rows.append(pd.DataFrame({"person": who[on], "company": name, "month": m, "adopted": new[on], "lost": gone[on]}))
                    on &= ~gone
                    lapsed = np.where(gone, m, lapsed)
                    tenure = np.where(on, tenure + 1, tenure)
                yield pd.concat(rows)

    return people.select("person", "age", "frailty").mapInPandas(run, "person long, company string, month int, adopted boolean, lost boolean")


def purchases(people: DataFrame, w: World) -> DataFrame:
    """person, company, month, no, amount; eleven months before the first are drawn too, for those active at its start."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("company"), F.lit(share).alias("share"), F.lit(rate).alias("rate"), F.lit(mu).alias("mu"), F.lit(sd).alias("sd")) for n, _, share, rate, mu, sd in SHOPS])).alias("x")
    p = people.select("person", "frailty", each).select("person", "frailty", "x.*").where(uniform(w.seed, "person", "company", 6) < F.col("share"))
    p = p.withColumn("month", F.explode(F.sequence(F.lit(-10), F.lit(w.months))))
    season = F.when(F.pmod("month", F.lit(12)).isin(10, 11, 0), 1.5).otherwise(1.0)
    count = poisson(uniform(w.seed, "person", "company", "month", 7), F.least(F.lit(3.0), F.col("rate") * F.col("frailty") * season))
    p = p.withColumn("no", F.explode(F.sequence(F.lit(0), count))).where("no > 0")
    return p.select("person", "company", "month", "no", F.round(F.exp(F.col("mu") + F.col("sd") * normal(w.seed, "person", "company", "month", "no", 8)), 2).alias("amount"))


def recruit(people: DataFrame, w: World) -> DataFrame:
    """panelist, person, age, income, region, joined, left: a skewed start, a wave skewed another way, monthly losses."""
    p = people.withColumn("_w", by_code("age", START_AGE) * by_code("income", START_INCOME))
    total = p.groupBy("age", "income").agg(F.sum("_w").alias("_s")).agg(F.sum("_s").alias("_all"))  # one row
    p = p.crossJoin(total).withColumn("_in", uniform(w.seed, "person", 9) < w.panel * F.col("_w") / F.col("_all"))
    start = p.where("_in").withColumn("joined", F.lit(1))
    # weighted draw without replacement: the smallest waiting times
    wait = -F.log(uniform(w.seed, "person", 10)) / (by_code("age", WAVE_AGE) * by_code("income", WAVE_INCOME))
    wave = p.where("not _in").withColumn("_t", wait).orderBy("_t", "person").limit(w.wave[1]).drop("_t").withColumn("joined", F.lit(w.wave[0]))
    both = start.unionByName(wave)
    stay = F.floor(F.log(uniform(w.seed, "person", 11)) / F.log(1 - by_code("age", GONE))).cast("int")
    left = F.col("joined") + 1 + stay
    return both.select((F.col("person") + 1).alias("panelist"), "person", "age", "income", "region", "joined", F.when(left > w.months, 0).otherwise(left).cast("int").alias("left"))


def instruments(panel: DataFrame, w: World) -> DataFrame:
    """panelist, usage (shares of the one to three instruments held), enrolled (at least one), capture."""
    names = F.array(*map(F.lit, range(len(INSTRUMENTS))))
    held = choice(uniform(w.seed, "panelist", 12), (5, 3, 2)) + 1
    draw = lambda i, salt, shares: -F.log(uniform(w.seed, "panelist", i, salt)) / by_code(i, shares)
    order = F.array_sort(F.transform(names, lambda i: F.struct(draw(i, 13, POPULAR).alias("t"), i.alias("i"))))
    own = F.transform(F.slice(order, F.lit(1), held), lambda x: x["i"])
    p = panel.select("panelist", own.alias("own"))
    weight = F.transform("own", lambda i: F.struct(i.alias("i"), (-F.log(uniform(w.seed, "panelist", i, 14)) * by_code(i, POPULAR)).alias("w")))
    p = p.select("panelist", "own", weight.alias("u"))
    some = F.filter("own", lambda i: uniform(w.seed, "panelist", i, 15) < by_code(i, ENROLLED))
    top = F.array_max(F.transform("u", lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"))))["i"]
    capture = F.pow(1 - F.pow(uniform(w.seed, "panelist", 16), F.lit(1 / 2.0)), F.lit(1 / 6.0))  # mostly between 0.7 and 1
    return p.select("panelist", "u", F.when(F.size(some) > 0, some).otherwise(F.array(top)).alias("enrolled"), capture.alias("capture"))


def _instrument(u: Column) -> Column:
    """The instrument of a usage list in whose share u falls."""
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x["w"])
    found = F.aggregate("u", F.struct(F.lit(0.0).alias("at"), F.lit(-1).alias("i")), lambda a, x: F.struct((a["at"] + x["w"]).alias("at"), F.when((a["i"] < 0) & (u * total < a["at"] + x["w"]), x["i"]).otherwise(a["i"]).alias("i")))
    return F.when(found["i"] < 0, F.element_at("u", -1)["i"]).otherwise(found["i"])


def feed(people: DataFrame, panel: DataFrame, subs: DataFrame, bought: DataFrame, w: World) -> DataFrame:
    """txn_id, panelist, day, descriptor, amount, instrument of what the panel shows, faults included."""
    held = instruments(panel, w)
    who = panel.select("person", "panelist", "joined", "left").join(held, "panelist")
    month = F.col("month")
    inside = (F.col("joined") <= month) & ((F.col("left") == 0) | (month < F.col("left")))
    prices = F.create_map(*[F.lit(x) for n, _, price, *_ in SUBSCRIPTIONS for x in (n, price)])
    price = F.when((F.col("company") == w.price_rise[0]) & (month >= w.price_rise[1]), w.price_rise[2]).otherwise(prices[F.col("company")])
    numbers = F.create_map(*[F.lit(x) for i, (n, *_) in enumerate(SUBSCRIPTIONS) for x in (n, i)])
    charges = subs.where(month >= 1).select("person", "company", "month", F.lit(0).alias("no"), price.alias("amount"), (1 + (F.col("person") * 7 + numbers[F.col("company")] * 11) % 28).alias("dom"))
    dom = 1 + F.floor(uniform(w.seed, "person", "company", "month", "no", 17) * 31)
    shop = bought.where(month >= 1).select("person", "company", "month", "no", "amount", dom.alias("dom"))
    noise = people.join(panel.select("person"), "person", "left_semi").select("person", F.lit("").alias("company"), F.explode(F.sequence(F.lit(1), F.lit(w.months))).alias("month"))
    noise = noise.withColumn("no", F.explode(F.sequence(F.lit(0), poisson(uniform(w.seed, "person", "month", 18), F.lit(NOISE[1]))))).where("no > 0")
    noise = noise.withColumn("amount", F.round(F.exp(NOISE[2] + NOISE[3] * normal(w.seed, "person", "month", "no", 19)), 2)).withColumn("dom", dom)
    rows = charges.unionByName(shop).unionByName(noise).join(who, "person").where(inside)
    billed = F.col("company").isin([n for n, *_ in SUBSCRIPTIONS])  # a subscription keeps to one instrument
    which = _instrument(F.when(billed, uniform(w.seed, "person", "company", 20)).otherwise(uniform(w.seed, "person", "company", "month", "no", 21)))
    rows = rows.withColumn("_i", which).where(F.array_contains("enrolled", F.col("_i")) & (uniform(w.seed, "person", "company", "month", "no", 22) < F.col("capture")))
    names = F.create_map(*[F.lit(x) for n, d, *_ in (*SUBSCRIPTIONS, *SHOPS) for x in (n, d)], F.lit(""), F.lit(NOISE[0]))
    day = day_of(month, F.col("dom"))
    suffix = F.concat(F.lit(" "), F.substring(F.lit("ABCDEFGHJKMNPQRSTUVWXYZ"), 1, 1), F.pmod(F.xxhash64("person", "month", "no"), F.lit(10)).cast("string"))
    descriptor = F.when((F.col("company") == w.renamed[0]) & (day >= w.renamed[1]), F.concat(F.lit(w.renamed[2]), suffix)).otherwise(names[F.col("company")])
    x = rows.select("panelist", day.alias("day"), descriptor.alias("descriptor"), "amount", F.element_at(F.array(*map(F.lit, INSTRUMENTS)), F.col("_i") + 1).alias("instrument"))
    x = x.where(~((F.col("instrument") == w.outage[0]) & F.col("day").between(w.outage[1], w.outage[2])))
    # the doubled day holds no equal rows of its own: they differ by a cent, then every row comes three times
    one = x.where(F.col("day") == w.doubled)
    again = F.row_number().over(W.partitionBy("panelist", "descriptor", "amount", "instrument").orderBy("day")) - 1
    one = one.withColumn("amount", F.round(F.col("amount") + again * 0.01, 2))
    copies = one.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return numbered(x.where(F.col("day") != w.doubled).withColumn("copy", F.lit(0)).unionByName(copies))


def numbered(x: DataFrame) -> DataFrame:
    """txn_id from 1 in the order of day and content: numbers within a day on top of all days before, which are a calendar."""
    by = ["panelist", "descriptor", "amount", "instrument", "copy"]
    days = x.groupBy("day").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("day").orderBy(*by))).join(F.broadcast(days), "day")
    return x.select((F.col("_before") + F.col("_r")).cast("long").alias("txn_id"), "panelist", "day", "descriptor", "amount", "instrument")


def planted(w: World) -> list[tuple[str, str, str, str]]:
    """(fault, first day, last day, what) of all that a detector should find."""
    month = f"{2022 + (w.wave[0] - 1) // 12}-{(w.wave[0] - 1) % 12 + 1:02d}-01"
    return [("doubled_day", w.doubled, w.doubled, "rows"), ("recruitment_wave", month, month, str(w.wave[1])), ("supplier_outage", w.outage[1], w.outage[2], w.outage[0]), ("descriptor_change", w.renamed[1], "", w.renamed[0])]


def truth(subs: DataFrame, bought: DataFrame, w: World) -> DataFrame:
    """company, quarter, revenue, actives, gross_adds, churned, prior_actives, churn_rate, arpu, market_share of the whole
    market: subscribers at the quarter's last day, customers of the twelve months up to it."""
    month = F.col("month")
    prices = F.create_map(*[F.lit(x) for n, _, price, *_ in SUBSCRIPTIONS for x in (n, price)])
    price = F.when((F.col("company") == w.price_rise[0]) & (month >= w.price_rise[1]), w.price_rise[2]).otherwise(prices[F.col("company")])
    q = F.floor((month - 1) / 3).cast("int")  # month 0 lies in quarter -1
    a = subs.withColumn("quarter", q).groupBy("company", "quarter").agg(
        F.sum(F.when(month >= 1, price).otherwise(0).cast("decimal(18,2)")).cast("double").alias("revenue"), F.count_if((month % 3 == 0) & ~F.col("lost")).alias("actives"),
        F.count_if(F.col("adopted") & (month >= 1)).alias("gross_adds"), F.count_if(F.col("lost") & (month >= 1)).alias("churned"),
    )
    seen = F.explode(F.sequence(q, q + 4)).alias("quarter")
    b = bought.select("person", "company", "month", "amount", q.alias("_q"), seen)
    b = b.groupBy("person", "company", "quarter").agg(F.sum(F.when((F.col("quarter") == F.col("_q")) & (month >= 1), F.col("amount")).otherwise(0).cast("decimal(18,2)")).alias("r"), F.max((F.col("quarter") <= F.col("_q") + 3).cast("int")).alias("now"), F.max((F.col("quarter") > F.col("_q")).cast("int")).alias("before"))
    b = b.groupBy("company", "quarter").agg(F.sum("r").cast("double").alias("revenue"), F.sum("now").alias("actives"), F.sum(F.col("now") * (1 - F.col("before"))).alias("gross_adds"), F.sum(F.col("before") * (1 - F.col("now"))).alias("churned"))
    g = a.unionByName(b).withColumn("prior_actives", F.coalesce(F.lag("actives").over(W.partitionBy("company").orderBy("quarter")), F.lit(0)))
    g = g.where((F.col("quarter") >= 0) & (F.col("quarter") < w.months // 3))
    share = 100 * F.col("revenue") / F.sum("revenue").over(W.partitionBy("quarter"))
    return g.withColumn("churn_rate", F.when(F.col("prior_actives") > 0, F.col("churned") / F.col("prior_actives")).otherwise(0.0)).withColumn("arpu", F.when(F.col("actives") > 0, F.col("revenue") / F.col("actives")).otherwise(0.0)).withColumn("market_share", share)


def reported(facts: DataFrame, revenue_unit: float = 1e5, active_unit: float = 1e3) -> DataFrame:
    """What companies disclose: revenue and actives, rounded half to even."""
    return facts.select("company", "quarter", (F.bround(F.col("revenue") / revenue_unit) * revenue_unit).alias("revenue"), (F.bround(F.col("actives") / active_unit) * active_unit).alias("actives"))


def companies(s: SparkSession) -> DataFrame:
    rows = [(n, d, True) for n, d, *_ in SUBSCRIPTIONS] + [(n, d, False) for n, d, *_ in SHOPS]
    return s.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("company"), F.lit(d).alias("core"), F.lit(x).alias("subscription")) for n, d, x in rows])))


def mapped(x: DataFrame, names: DataFrame) -> DataFrame:
    """The columns that estimators read, with the company of each row by its core (null: none of interest)."""
    m = x.join(F.broadcast(names.select("core", "company")), "core", "left")
    return m.select("panelist", "company", "month", "day", "instrument", F.col("amount").cast("decimal(18,2)").alias("amount"))


def month_of(day: Column) -> Column:
    return ((F.year(day) - 2022) * 12 + F.month(day)).cast("int")


def study(panel: DataFrame, raw: DataFrame, corrected: DataFrame, names: DataFrame, margins: DataFrame, reports: DataFrame, outages: DataFrame, w: World) -> Panel:
    """The inputs of the estimators from a raw feed and its repaired version, both with core and month."""
    known = names.select("company", "subscription").distinct()
    o = outages.select("instrument", F.col("first").alias("start"), F.col("last").alias("end"), quarter_of(month_of(F.col("first"))).alias("quarter"))
    return Panel(mapped(raw, companies(raw.sparkSession)), panel.select("panelist", "age", "income", "region", "joined", "left"), known, margins, reports, w.months, o, mapped(corrected, names))
