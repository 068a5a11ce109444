"""A simulated set of software vendors, what becomes of them, and the exhaust they leave: postings, traffic, card spend.

Paths of a vendor are recurrences over its quarters and are made vendor by vendor in batches; what a quarter emits is
drawn from hashes of keys by DataFrame code. Everything is a pure function of size and seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .draws import choice, normal, uniform
from .panelworld import _uniforms

SEGMENTS = ("devtools", "data", "security", "ai_apps", "ai_infra")
#: Shares of archetypes, and the quarterly growth that each starts and ends with.
ARCHETYPES = (("steady", 5, 0.04, 0.04), ("acceleration", 3, 0.03, 0.16), ("stall", 3, 0.12, -0.02), ("wind_down", 2, 0.03, -0.15))
#: Growth must change by this much to count as an inflection.
INFLECTION = 0.08
TITLES = (("engineering", "Software Engineer", 5), ("sales", "Account Executive", 3), ("marketing", "Growth Marketer", 2), ("support", "Support Specialist", 2), ("research", "Research Scientist", 1))
PLACES = ("remote", "us", "eu", "apac")
#: Share of vendors with a spend channel by segment; visits at usage one.
CHANNEL, VISITS = (0.8, 0.6, 0.5, 0.9, 0.3), (40_000, 15_000, 12_000, 60_000, 6_000)


@dataclass(frozen=True)
class Vendors:
    """Size, seed and planted faults of a vendor world: quarters count from 0, January 2022."""

    count: int = 480
    quarters: int = 12
    seed: int = 23
    storm: tuple[int, int] = (5, 6)  # quarters in which one vendor relists everything
    spike: int = 7  # quarter in whose first two months robots visit one vendor
    renamed: int = 8  # quarter in which one vendor's descriptors fade into new ones
    dark: tuple[str, int, int] = ("ai_apps", 9, 10)  # segment without spend in these quarters


def vendors(s: SparkSession, w: Vendors) -> DataFrame:
    """vendor, segment, archetype, arr (millions), headcount."""
    v = s.range(w.count).withColumnRenamed("id", "vendor")
    names = lambda xs, u: F.element_at(F.array(*map(F.lit, xs)), u + 1)
    arr = F.exp(1.8 + 1.1 * normal(w.seed, "vendor", 3))
    v = v.select("vendor", names(SEGMENTS, choice(uniform(w.seed, "vendor", 1), (1,) * len(SEGMENTS))).alias("segment"), names([a for a, *_ in ARCHETYPES], choice(uniform(w.seed, "vendor", 2), [n for _, n, *_ in ARCHETYPES])).alias("archetype"), arr.alias("arr"))
    return v.withColumn("headcount", F.greatest(F.lit(5.0), F.round(F.col("arr") * 5 * F.exp(0.3 * normal(w.seed, "vendor", 4)))))


def paths(of: DataFrame, w: Vendors) -> DataFrame:
    """vendor, segment, quarter, growth, arr, usage, headcount, requisitions, inflection, event, disclosed, months (in which
    it still emits), first_arr of every vendor and quarter up to its end.

    Growth changes at one point (two for a vendor that winds down) and reaches revenue over two quarters and usage over
    one; hiring follows the plan at once. Funding, acquisition and shutdown are hazards; three fifths of the acquired
    disclose their revenue a quarter later.
    """
    starts = {a: (x, y) for a, _, x, y in ARCHETYPES}

    def one(r) -> list[tuple]:
        u = lambda *k: float(_uniforms(np.array([r.vendor]), w.seed, *k)[0])
        low, high = starts[r.archetype]
        turn = 3 + int(u(1) * (w.quarters - 5)) if r.archetype != "steady" else w.quarters
        base = low + 0.03 * (u(2) - 0.5)
        end = high + 0.04 * (u(3) - 0.5)
        plan = [base if t < turn else end if r.archetype != "wind_down" or t >= turn + 2 else (base + end) / 2 for t in range(w.quarters)]
        lag = lambda t, k: plan[max(0, t - k)]
        arr, usage, staff, noise, runway, wait, falls = r.arr, 1.0, r.headcount, 0.0, 4 + int(u(4) * 8), 0, 0
        rows, gone = [], None
        for t in range(w.quarters):
            if gone is not None and t > gone[1]:
                if gone[0] == "acquisition" and t == gone[1] + 1 and u(5) < 0.6:
                    rows.append((r.vendor, r.segment, t, None, None, None, None, None, None, "disclosure", max(1.0, round(gone[2])), 0, r.arr))
                break
            z = np.sqrt(-2 * np.log(u(t, 6))) * np.cos(2 * np.pi * u(t, 7))
            noise = 0.5 * noise + 0.015 * z
            growth = lag(t, 2) + (lag(t, 1) - lag(t, 2)) / 3 + noise
            arr, usage = max(0.01, arr * (1 + growth)), usage * (1 + lag(t, 1))
            hires = staff * plan[t] * 0.8 + staff * 0.03 if plan[t] >= 0 else 0.0
            staff = max(1.0, staff * (1 + (plan[t] if plan[t] >= 0 else min(0.0, lag(t, 1)))))
            falls = falls + 1 if growth < 0 else 0
            step = plan[t] - plan[t - 1] if t else 0.0
            event, months = None, 3
            wait, runway = wait - 1, runway - 1
            if wait < 0 and u(t, 8) < (0.15 if step > 0 or plan[t] > 0.1 else 0.05):
                event, runway, wait = "funding", 6 + int(u(t, 9) * 6), 4
            if u(t, 10) < 0.006 * (2 if plan[t] > 0.1 or (r.archetype == "stall" and t >= turn) else 1):
                event, gone = "acquisition", ("acquisition", t, arr)
            elif runway < 2 and u(t, 11) < (0.4 if r.archetype == "wind_down" and t >= turn + 2 else 0.01 + 0.03 * max(0, falls - 2)):
                event, gone, months = "shutdown", ("shutdown", t, arr), 1
            rows.append((r.vendor, r.segment, t, growth, arr, usage, staff, hires, ("acceleration" if step > 0 else "stall") if abs(step) >= INFLECTION else None, event, None, months, r.arr))
        return rows

    names = "vendor long, segment string, quarter int, growth double, arr double, usage double, headcount double, requisitions double, inflection string, event string, disclosed double, months int, first_arr double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([x for r in pdf.itertuples() for x in one(r)], columns=[c.split()[0] for c in names.split(", ")])

    return of.mapInPandas(run, names)


def planted(p: DataFrame, quarters: tuple[int, ...], least: float, w: Vendors, salt: int) -> DataFrame:
    """One vendor that emits through the quarters, hires enough in them and has no inflection there: a fault planted on it
    can be measured. The choice is by hash."""
    inside = F.col("quarter").isin(*quarters)
    ok = p.groupBy("vendor").agg(F.count_if(inside & (F.col("months") == 3)).alias("n"), F.sum(F.when(inside, F.col("requisitions")).otherwise(0)).alias("reqs"), F.count_if(inside & F.col("inflection").isNotNull()).alias("turns"))
    ok = ok.where((F.col("n") == len(quarters)) & (F.col("reqs") >= least) & (F.col("turns") == 0))
    return ok.select("vendor", uniform(w.seed, "vendor", salt).alias("_u")).orderBy("_u").limit(1).select("vendor")


def _day(quarter: Column, u: Column, months: Column) -> Column:
    first = F.add_months(F.lit("2022-01-01").cast("date"), (quarter * 3).cast("int"))
    return F.date_add(first, F.floor(u * months * 30.4).cast("int"))


def postings(p: DataFrame, storm: DataFrame, w: Vendors) -> DataFrame:
    """vendor, no, title, place, posted: a row a requisition and, for a storming vendor, four more of each some 17 days
    apart within the quarter; one in twenty of all others is listed again in the next quarter."""
    x = p.where("months > 0").withColumn("no", F.explode(F.sequence(F.lit(0), F.round(F.col("requisitions") * F.col("months") / 3).cast("int")))).where("no > 0")
    key = ("vendor", "quarter", "no")
    title = F.element_at(F.array(*[F.lit(t) for _, t, _ in TITLES]), choice(uniform(w.seed, *key, 31), [n for *_, n in TITLES]) + 1)
    place = F.element_at(F.array(*map(F.lit, PLACES)), choice(uniform(w.seed, *key, 32), (4, 3, 2, 1)) + 1)
    x = x.select("vendor", "quarter", "no", F.concat(title, F.lit(" "), F.col("no").cast("string")).alias("title"), place.alias("place"), _day(F.col("quarter"), uniform(w.seed, *key, 33), F.col("months")).alias("posted"), uniform(w.seed, *key, 34).alias("_again"))
    x = x.join(F.broadcast(storm.withColumn("_storm", F.lit(True))), "vendor", "left").withColumn("_storm", F.coalesce("_storm", F.lit(False)) & F.col("quarter").between(*w.storm))
    again = F.when(F.col("_storm"), F.sequence(F.lit(0), F.lit(4))).when(F.col("_again") < 0.05, F.array(F.lit(0), F.lit(9))).otherwise(F.array(F.lit(0)))
    x = x.withColumn("k", F.explode(again))
    late = F.date_add("posted", F.when(F.col("k") == 9, 91).otherwise(F.col("k") * 17).cast("int"))
    end = F.add_months(F.lit("2022-01-01").cast("date"), (F.col("quarter") * 3 + 3).cast("int"))
    return x.withColumn("late", late).where((F.col("k") == 9) | (F.col("late") < end)).select("vendor", F.concat_ws("-", "vendor", "quarter", "no", "k").alias("no"), "title", "place", F.col("late").alias("posted"))


def traffic(p: DataFrame, spike: DataFrame, w: Vendors) -> DataFrame:
    """vendor, month (from 0), visits of the vendors that the panel covers; small ones are missing more often."""
    x = p.where("months > 0").where(uniform(w.seed, "vendor", 41) > F.when(F.col("first_arr") < 4, 0.3).otherwise(0.08))
    x = x.withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("months") - 1))).withColumn("month", (F.col("quarter") * 3 + F.col("_m")).cast("int"))
    scale = F.element_at(F.array(*[F.lit(float(v)) for v in VISITS]), F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("segment")).cast("int"))
    visits = scale * F.pow("usage", F.lit(0.8)) * F.exp(0.5 * normal(w.seed, "vendor", 42)) * (1 + 0.05 * F.sin(F.col("month") * 0.5236)) * F.exp(0.08 * normal(w.seed, "vendor", "month", 43))
    x = x.join(F.broadcast(spike.withColumn("_spike", F.lit(True))), "vendor", "left")
    robots = F.when(F.coalesce("_spike", F.lit(False)) & (F.col("quarter") == w.spike) & (F.col("_m") < 2), F.lit(5.0) - F.col("_m")).otherwise(1.0)
    return x.select("vendor", "month", F.greatest(F.lit(1), F.round(visits * robots)).cast("long").alias("visits"))


def descriptor(vendor: Column, style: int) -> Column:
    """How a vendor is written on a statement; names differ for the first 17,576 vendors."""
    name = F.concat(F.lit("VENDOR "), F.chr(65 + F.pmod(vendor, F.lit(26))), F.chr(65 + F.pmod(F.floor(vendor / 26), F.lit(26))), F.chr(65 + F.pmod(F.floor(vendor / 676), F.lit(26))))
    return (name, F.concat(F.lit("SQ *"), name), F.concat(name, F.lit(" INC")), F.concat(F.lit("PYMT "), name))[style]


def spend(p: DataFrame, fading: DataFrame, w: Vendors) -> DataFrame:
    """descriptor, day, amount, panelist: rows follow growth, amounts a vendor's size; one vendor's descriptors fade into
    new ones within a quarter, and a segment is dark in some quarters."""
    shares = F.element_at(F.array(*map(F.lit, CHANNEL)), F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("segment")).cast("int"))
    x = p.where("months > 0").join(F.broadcast(fading.withColumn("_fades", F.lit(True))), "vendor", "left").withColumn("_fades", F.coalesce("_fades", F.lit(False)))
    x = x.where(F.col("_fades") | (uniform(w.seed, "vendor", 51) < shares)).where(~((F.col("segment") == w.dark[0]) & F.col("quarter").between(w.dark[1], w.dark[2])))
    rows = F.least(F.lit(300), F.round(40 * F.exp(0.4 * normal(w.seed, "vendor", 52)) * F.col("arr") / F.col("first_arr") * F.exp(0.1 * normal(w.seed, "vendor", "quarter", 53)) * F.col("months") / 3).cast("int"))
    x = x.withColumn("no", F.explode(F.sequence(F.lit(0), rows))).where("no > 0")
    key = ("vendor", "quarter", "no")
    u = uniform(w.seed, *key, 54)
    past = F.when(F.col("quarter") > w.renamed, 1.0).when(F.col("quarter") == w.renamed, F.least(F.lit(1.0), u * 2)).otherwise(0.0)  # fades over half of the quarter
    new = F.col("_fades") & (uniform(w.seed, *key, 55) < past)
    v = F.col("vendor")
    which = F.when(new, F.when(uniform(w.seed, *key, 56) < 0.5, descriptor(v, 2)).otherwise(descriptor(v, 3))).when(uniform(w.seed, *key, 57) < 0.75, descriptor(v, 0)).otherwise(descriptor(v, 1))
    amount = F.greatest(F.lit(5.0), F.col("first_arr") * 100 * F.exp(0.4 * normal(w.seed, *key, 58)))
    who = (v * 40 + F.floor(uniform(w.seed, *key, 59) * 40)) % 5000
    return x.select(which.alias("descriptor"), _day(F.col("quarter"), u, F.col("months")).alias("day"), F.round(amount, 2).alias("amount"), who.alias("panelist"))


def descriptor_map(of: DataFrame) -> DataFrame:
    """descriptor, vendor as first known: not those that a vendor takes up later."""
    v = F.col("vendor")
    return of.select(F.explode(F.array(descriptor(v, 0), descriptor(v, 1))).alias("descriptor"), "vendor")


def disclosures(p: DataFrame) -> DataFrame:
    """vendor, quarter (of the acquisition), disclosed revenue in millions."""
    return p.where("event = 'disclosure'").select("vendor", (F.col("quarter") - 1).alias("quarter"), "disclosed")


def titles(s: SparkSession, per: int = 30) -> DataFrame:
    """title, function: a set to grade a tagger with, seniority words before and after."""
    marks = ("", "Senior ", "Staff ", "Lead ", "Principal ", "Junior ")
    rows = [(f"{marks[i % len(marks)]}{t}{' II' if i % 4 == 3 else ''}", f) for f, t, _ in TITLES for i in range(per)]
    return s.createDataFrame(rows, "title string, function string")


