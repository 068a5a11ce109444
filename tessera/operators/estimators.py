"""Estimators of company indicators from a consumer panel: a ladder of four methods behind one call.

m1 scales raw sums by population over the panelists of the first month. m2 rakes the active panel to census margins each
quarter. m3 adds subscription spells and what outages hid, on corrected rows. m4 calibrates m3 to earlier reports.
Everything is an aggregate by panelist, company and quarter, joined with a weight by panelist and quarter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order
from . import panel as P

#: The methods, the indicators, the largest share that an outage may have hidden.
METHODS = ("m1", "m2", "m3", "m4")
KPIS = ("revenue", "actives", "gross_adds", "churn_rate", "arpu", "market_share")
MOST_HIDDEN = 0.8


@dataclass
class Panel:
    """The inputs of all methods. Months count from 1, quarters from 0.

    txns: panelist, company (null: none of interest), month, day, instrument, amount. panelists: panelist, age, income,
    region, joined, left (0: still there). companies: company, subscription. margins: margin (age_income or region), age,
    income, region, population. reported: company, quarter, revenue, actives. outages: instrument, start, end, quarter.
    corrected: txns after repairs, for m3 and m4; None if txns need none.
    """

    txns: DataFrame
    panelists: DataFrame
    companies: DataFrame
    margins: DataFrame
    reported: DataFrame
    months: int
    outages: DataFrame | None = None
    corrected: DataFrame | None = None
    tolerance: float = P.TOLERANCE  # of raking

    @property
    def quarters(self) -> int:
        return self.months // 3


def quarter_of(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int")


def _there(quarter: Column) -> Column:
    """Whether a panelist (joined, left) is in the panel at the end of a quarter."""
    end = 3 * (quarter + 1)
    return (F.col("joined") <= end) & ((F.col("left") == 0) | (F.col("left") > end))


def active(p: Panel, txns: DataFrame) -> DataFrame:
    """(panelist, quarter, age, income, region): seen in the quarter or the one before, and in the panel at its end."""
    q = quarter_of(F.col("month"))
    seen = txns.select("panelist", F.explode(F.array(q, q + 1)).alias("quarter")).where(F.col("quarter") < p.quarters).distinct()
    return seen.join(p.panelists, "panelist").where(_there(F.col("quarter"))).select("panelist", "quarter", "age", "income", "region")


def raked_weights(p: Panel, txns: DataFrame) -> DataFrame:
    """(panelist, quarter, weight) of the active panel, raked to the margins quarter by quarter."""
    a = active(p, txns)
    cells = a.groupBy("quarter", "age", "income", "region").agg(F.count("*").cast("double").alias("n"))
    return a.join(P.rake(cells, p.margins, ["quarter"], p.tolerance).drop("n"), ["quarter", "age", "income", "region"]).select("panelist", "quarter", "weight")


def naive_weight(p: Panel) -> DataFrame:
    """One row: population over the panelists that joined in the first month."""
    first = p.panelists.agg(F.count_if(F.col("joined") == 1).alias("n"))
    return p.margins.where("margin = 'region'").agg(F.sum("population").alias("all")).crossJoin(first).select((F.col("all") / F.col("n")).alias("weight"))


def indicators(p: Panel, txns: DataFrame, spells: bool) -> DataFrame:
    """(panelist, company, quarter, rev, act, add, num, den) before weights.

    A subscription is active in a quarter if it is charged in its last month, with spells also if a single missing month
    is bridged there. It is added when first seen after month 1, or when a spell starts after the panelist has joined;
    it is lost when charged at one quarter's end and not at the next, or when a spell ends well before the panelist
    leaves. Other purchases make a customer active for twelve months. den is what could be lost.
    """
    month = F.col("month")
    m = txns.where("company is not null").groupBy("panelist", "company", "month").agg(F.sum("amount").alias("rev"))
    w = W.partitionBy("panelist", "company").orderBy("month")
    m = m.withColumn("_last", F.lag("month").over(w)).withColumn("_next", F.lead("month").over(w))
    m = m.join(p.panelists.select("panelist", "joined", "left"), "panelist").join(p.companies.select("company", "subscription"), "company")
    q = quarter_of(month)
    off, on, zero = F.lit(0), F.lit(1), F.lit(0.0)
    row = lambda quarter, rev=zero, act=off, prev=off, add=off, end=off: F.struct(quarter.alias("quarter"), rev.cast("double").alias("rev"), act.cast("int").alias("act"), prev.cast("int").alias("prev"), add.cast("int").alias("add"), end.cast("int").alias("end"))
    if spells:
        bridged = F.coalesce(F.col("_next") == month + 2, F.lit(False))
        at_end = (month % 3 == 0) | (bridged & (month % 3 == 2))
        add = F.coalesce(F.col("_last") < month - 2, F.lit(True)) & (month >= 2) & (F.col("joined") <= month - 1)
        end = F.coalesce(F.col("_next") > month + 2, F.lit(True)) & (month < p.months) & ((F.col("left") == 0) | (F.col("left") > month + 2))
    else:
        bridged, at_end, end = F.lit(False), month % 3 == 0, F.lit(False)
        add = F.col("_last").isNull() & (month >= 2)
    # a month bridged into the next quarter's end cannot be: month % 3 = 2 bridges month + 1, the end of the same quarter
    charged = [row(q, F.col("rev"), at_end, off, add, end), F.when(at_end, row(q + 1, prev=on))]
    bought = [row(q, F.col("rev"), on), *[row(q + k, act=on, prev=on) for k in (1, 2, 3)], row(q + 4, prev=on)]
    each = F.when(F.col("subscription"), F.array_compact(F.array(*charged))).otherwise(F.array(*bought))
    f = m.select("panelist", "company", "subscription", "joined", "left", F.explode(each).alias("x")).select("panelist", "company", "subscription", "joined", "left", "x.*")
    f = f.where(F.col("quarter") < p.quarters).groupBy("panelist", "company", "subscription", "joined", "left", "quarter")
    f = f.agg(F.sum("rev").alias("rev"), F.max("act").alias("act"), F.max("prev").alias("prev"), F.max("add").alias("add"), F.sum("end").alias("end"))
    lost, there = F.col("prev") * (1 - F.col("act")), _there(F.col("quarter")).cast("int")
    sub = F.col("subscription")
    adds = F.when(sub, F.col("add")).otherwise(F.col("act") * (1 - F.col("prev")) * (F.col("quarter") >= 1).cast("int"))
    num = F.when(sub, F.col("end") if spells else lost * there).otherwise(lost)
    den = F.when(sub, F.col("prev") if spells else F.col("prev") * there).otherwise(F.col("prev"))
    return f.select("panelist", "company", "quarter", "rev", "act", adds.alias("add"), num.alias("num"), den.alias("den"))


def hidden_revenue(p: Panel, txns: DataFrame, weights: DataFrame) -> DataFrame:
    """(company, quarter, hidden): what an outage of an instrument kept from the panel, by the instrument's share of a
    company's weighted revenue from the first of the second month before it. The outages are a short list."""
    o = p.outages.select(F.monotonically_increasing_id().alias("_w"), F.col("instrument").alias("_i"), "start", "end", "quarter")
    before = F.add_months(F.trunc("start", "MM"), -2)
    t = txns.where("company is not null").join(F.broadcast(o), (F.col("day") >= before) & (F.col("day") <= F.col("end")))
    early = F.col("day") < F.col("start")
    amount = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0)).cast("double")
    s = t.groupBy("_w", "quarter", "company", "panelist").agg(amount(~early).alias("win"), amount(early).alias("all"), amount(early & (F.col("instrument") == F.col("_i"))).alias("slice"))
    s = s.join(weights, ["panelist", "quarter"]).groupBy("_w", "quarter", "company").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("win", "all", "slice")])
    share = F.least(F.greatest(F.when(F.col("all") > 0, F.col("slice") / F.col("all")).otherwise(0.0), F.lit(0.0)), F.lit(MOST_HIDDEN))
    return s.groupBy("company", "quarter").agg(F.sum(F.col("win") * share / (1 - share)).alias("hidden"))


def grid(p: Panel) -> DataFrame:
    """Every company in every quarter."""
    return p.companies.select("company").crossJoin(p.companies.sparkSession.range(p.quarters).select(F.col("id").cast("int").alias("quarter")))


def _kpis(sums: DataFrame) -> DataFrame:
    """company, quarter, and the six indicators, of sums rev, act, add, num, den."""
    all_rev = F.sum("rev").over(W.partitionBy("quarter"))
    return sums.select(
        "company", "quarter", F.col("rev").alias("revenue"), F.col("act").cast("double").alias("actives"), F.col("add").cast("double").alias("gross_adds"),
        F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0).alias("churn_rate"),
        F.when(F.col("act") > 0, F.col("rev") / F.col("act")).otherwise(0.0).alias("arpu"),
        F.when(all_rev > 0, 100.0 * F.col("rev") / all_rev).otherwise(100.0 * F.col("rev")).alias("market_share"),
    )


def _weighted(p: Panel, txns: DataFrame, weights: DataFrame, spells: bool) -> DataFrame:
    """Weighted sums of the indicators for every company and quarter; weights of one column hold for all."""
    i = indicators(p, txns, spells)
    i = i.join(weights, ["panelist", "quarter"]) if "panelist" in weights.columns else i.crossJoin(F.broadcast(weights))
    s = i.groupBy("company", "quarter").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("rev", "act", "add", "num", "den")])
    if spells and p.outages is not None:
        s = s.join(hidden_revenue(p, txns, weights), ["company", "quarter"], "left").withColumn("rev", F.col("rev") + F.coalesce("hidden", F.lit(0.0)))
    return grid(p).join(s, ["company", "quarter"], "left").fillna(0.0, ["rev", "act", "add", "num", "den"])


def calibrated(p: Panel, m3: DataFrame) -> DataFrame:
    """m3 times the geometric mean of the up to three latest earlier ratios of report to estimate; additions follow the
    actives, revenue per active and shares are derived anew, churn stays."""
    r = p.reported.select("company", "quarter", F.col("revenue").alias("rep_rev"), F.col("actives").alias("rep_act"))
    d = m3.join(r, ["company", "quarter"], "left")
    d = P.prior_ratio(d, ["company"], "quarter", "rep_rev", "revenue").withColumnRenamed("factor", "f_rev")
    d = P.prior_ratio(d, ["company"], "quarter", "rep_act", "actives").withColumnRenamed("factor", "f_act")
    d = d.select("company", "quarter", (F.col("revenue") * F.col("f_rev")).alias("rev"), (F.col("actives") * F.col("f_act")).alias("act"), (F.col("gross_adds") * F.col("f_act")).alias("add"), F.col("churn_rate").alias("num"), F.lit(1.0).alias("den"))
    return _kpis(d)


def wide(method: str, p: Panel) -> DataFrame:
    """company, quarter and the six indicators by one method."""
    fixed = p.txns if p.corrected is None else p.corrected
    if method == "m1":
        return _kpis(_weighted(p, p.txns, naive_weight(p), False))
    if method == "m2":
        return _kpis(_weighted(p, p.txns, raked_weights(p, p.txns), False))
    if method == "m3":
        return _kpis(_weighted(p, fixed, raked_weights(p, fixed), True))
    if method == "m4":
        return calibrated(p, wide("m3", p))
    raise ValueError(f"no method {method}")


def estimate(method: str, p: Panel, quarter: int | None = None) -> DataFrame:
    """company, quarter, kpi, estimate by one method, of one quarter or all."""
    d = wide(method, p).unpivot(["company", "quarter"], list(KPIS), "kpi", "estimate")
    return d if quarter is None else d.where(F.col("quarter") == quarter)


def estimate_table(p: Panel, first_scored: int, intervals: DataFrame | None = None) -> DataFrame:
    """method, company, quarter, kpi, estimate, ci_low, ci_high, scored of all methods; intervals as from bootstrap()."""
    every = reduce(DataFrame.unionByName, [estimate(m, p).withColumn("method", F.lit(m)) for m in METHODS])
    if intervals is None:
        every = every.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    else:
        every = every.join(intervals, ["method", "company", "quarter", "kpi"], "left")
    return every.select("method", "company", "quarter", "kpi", "estimate", "ci_low", "ci_high", (F.col("quarter") >= first_scored).alias("scored"))


# --- bootstrap of panelists


#: Panelists of a leaf of the tree of draws.
LEAF = 64


def _random(seed: int, low: int, high: int) -> np.random.Generator:
    """The generator of a node: the same in every task and on every retry."""
    return np.random.Generator(np.random.Philox(key=np.array([(seed << 40) + low, high], np.uint64)))


def draws(places: np.ndarray, panel: int, replicates: int, seed: int) -> np.ndarray:
    """How often the panelists at some distinct places (from 0) are drawn in each replicate of panel draws with replacement: the counts
    of all places are multinomial and add up to the panel's size.

    A tree halves the panel: of a node's draws a binomial number, by the node's own generator, goes to its left half, until
    a leaf's draws fall on its panelists evenly. Only nodes above the asked places are drawn, so tasks agree without
    talking to each other.
    """
    out = np.zeros((len(places), replicates))
    leaves, leaf_of = np.unique(places // LEAF, return_inverse=True)
    nodes = [(0, -(-panel // LEAF), np.full(replicates, panel, np.int64), 0, len(leaves))]  # leaves low to high, draws, which of leaves are asked
    while nodes:
        low, high, n, first, last = nodes.pop()
        if first == last:
            continue
        size = min(high * LEAF, panel) - low * LEAF
        if high - low == 1:
            slots = _random(seed, low, high).integers(0, size, n.sum())
            counts = np.bincount(np.repeat(np.arange(replicates), n) * size + slots, minlength=replicates * size).reshape(replicates, size)
            own = np.flatnonzero(leaf_of == first)
            out[own] = counts[:, places[own] - low * LEAF].T
            continue
        mid = (low + high) // 2
        left = _random(seed, low, high).binomial(n, (mid - low) * LEAF / size)
        at = first + int(np.searchsorted(leaves[first:last], mid))
        nodes += [(low, mid, left, first, at), (mid, high, n - left, at, last)]
    return out


def placed(panelists: DataFrame) -> tuple[DataFrame, int]:
    """(panelist, place) of the distinct panelists in their order, and their number."""
    one = panelists.where("panelist is not null").groupBy("panelist").agg(F.lit(1).cast("long").alias("_one"))
    places = order.sums_before(one, [], "panelist", "_one").select("panelist", F.col("before").alias("place"), "all")
    return places.drop("all"), places.agg(F.max("all")).first()[0] or 0


def _replicate_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], panel: tuple[DataFrame, int], replicates: int, seed: int) -> DataFrame:
    """keys, b and, for each value, its sum over panelists in replicate b. Rows are dealt by the places of their panelists, so that a task
    draws for a stretch of the panel; tasks sum before anything travels: a row for each key and task."""
    places, size = panel

    def part(frames):
        held: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for a in range(0, len(pdf), 8192):
                own = pdf.iloc[a : a + 8192]
                rows, where = np.unique(own["place"].to_numpy(), return_inverse=True)
                n = draws(rows, size, replicates, seed)[where]
                x = own[list(values)].to_numpy(float)
                for key, rows_of in own.groupby(list(keys)).indices.items():
                    s = x[rows_of].T @ n[rows_of]
                    key = key if isinstance(key, tuple) else (key,)
                    held[key] = held[key] + s if key in held else s
        yield pd.DataFrame([(*(k.item() if hasattr(k, "item") else k for k in key), *(r.tolist() for r in s)) for key, s in held.items()], columns=[*keys, *values])

    kinds = dict(df.dtypes)
    own = ", ".join(f"{k} {kinds[k]}" for k in keys)
    near = df.select("panelist", *keys, *values).join(places, "panelist").drop("panelist").repartitionByRange("place", *keys).sortWithinPartitions("place")
    rows = near.mapInPandas(part, f"{own}, " + ", ".join(f"{v} array<double>" for v in values))
    flat = rows.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("b", "x")).groupBy(*keys, "b")
    return flat.agg(*[F.sum(F.col("x")[v]).alias(v) for v in values])


def bootstrap(p: Panel, replicates: int = 400, low: float = 0.05, high: float = 0.95, seed: int = 7) -> DataFrame:
    """method, company, quarter, kpi, ci_low, ci_high of revenue and actives under a bootstrap of panelists.

    Every method runs anew in each replicate: weights are raked from its own counts, factors come from its own earlier
    estimates. Weights depend on cells only, so panelists are summed by cell and replicate before weights are known.
    """
    fixed = p.txns if p.corrected is None else p.corrected
    cell = ["age", "income", "region"]
    panel = placed(p.panelists)
    first = _replicate_sums(p.panelists.where("joined = 1").select("panelist", F.lit(1).alias("one"), F.lit(1.0).alias("n")), ["one"], ["n"], panel, replicates, seed)
    pop = p.margins.where("margin = 'region'").agg(F.sum("population").alias("all"))
    scale = first.crossJoin(pop).select("b", (F.col("all") / F.col("n")).alias("weight"))
    out = []
    for raw in (True, False):
        txns = p.txns if raw else fixed
        who = active(p, txns)
        counts = _replicate_sums(who.withColumn("n", F.lit(1.0)), ["quarter", *cell], ["n"], panel, replicates, seed)
        weight = P.rake(counts, p.margins, ["b", "quarter"], p.tolerance).drop("n")
        i = indicators(p, txns, not raw).select("panelist", "company", "quarter", "rev", F.col("act").cast("double").alias("act"))
        if raw:
            s = _replicate_sums(i, ["company", "quarter"], ["rev", "act"], panel, replicates, seed)
            out.append(s.join(scale, "b").select(F.lit("m1").alias("method"), "b", "company", "quarter", (F.col("rev") * F.col("weight")).alias("revenue"), (F.col("act") * F.col("weight")).alias("actives")))
        s = _replicate_sums(i.join(who, ["panelist", "quarter"]), ["company", "quarter", *cell], ["rev", "act"], panel, replicates, seed)
        s = s.join(weight, ["b", "quarter", *cell]).groupBy("b", "company", "quarter").agg(*[F.sum(F.col(c) * F.col("weight")).alias(n) for c, n in (("rev", "revenue"), ("act", "actives"))])
        s = grid(p).crossJoin(p.companies.sparkSession.range(replicates).select(F.col("id").cast("int").alias("b"))).join(s, ["b", "company", "quarter"], "left").fillna(0.0, ["revenue", "actives"])
        if not raw and p.outages is not None:
            s = s.join(_replicate_hidden(p, txns, weight, panel, replicates, seed), ["b", "company", "quarter"], "left").withColumn("revenue", F.col("revenue") + F.coalesce("hidden", F.lit(0.0)))
        s = s.select(F.lit("m2" if raw else "m3").alias("method"), "b", "company", "quarter", "revenue", "actives")
        out.append(s)
    r = p.reported.select("company", "quarter", F.col("revenue").alias("rep_rev"), F.col("actives").alias("rep_act"))
    d = out[-1].join(r, ["company", "quarter"], "left")
    d = P.prior_ratio(d, ["b", "company"], "quarter", "rep_rev", "revenue").withColumnRenamed("factor", "f_rev")
    d = P.prior_ratio(d, ["b", "company"], "quarter", "rep_act", "actives").withColumnRenamed("factor", "f_act")
    out.append(d.select(F.lit("m4").alias("method"), "b", "company", "quarter", (F.col("revenue") * F.col("f_rev")).alias("revenue"), (F.col("actives") * F.col("f_act")).alias("actives")))
    every = reduce(DataFrame.unionByName, out).unpivot(["method", "company", "quarter", "b"], ["revenue", "actives"], "kpi", "x")
    return every.groupBy("method", "company", "quarter", "kpi").agg(F.percentile("x", low).alias("ci_low"), F.percentile("x", high).alias("ci_high"))


def _replicate_hidden(p: Panel, txns: DataFrame, weight: DataFrame, panel: tuple[DataFrame, int], replicates: int, seed: int) -> DataFrame:
    cell = ["age", "income", "region"]
    o = p.outages.select(F.monotonically_increasing_id().alias("_w"), F.col("instrument").alias("_i"), "start", "end", "quarter")
    t = txns.where("company is not null").join(F.broadcast(o), (F.col("day") >= F.add_months(F.trunc("start", "MM"), -2)) & (F.col("day") <= F.col("end")))
    early = F.col("day") < F.col("start")
    amount = lambda c: F.when(c, F.col("amount")).otherwise(0).cast("double")
    t = t.select("panelist", "_w", "quarter", "company", amount(~early).alias("win"), amount(early).alias("all"), amount(early & (F.col("instrument") == F.col("_i"))).alias("slice"))
    t = t.join(active(p, txns), ["panelist", "quarter"])
    s = _replicate_sums(t, ["_w", "quarter", "company", *cell], ["win", "all", "slice"], panel, replicates, seed).join(weight, ["b", "quarter", *cell])
    s = s.groupBy("b", "_w", "quarter", "company").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("win", "all", "slice")])
    share = F.least(F.greatest(F.when(F.col("all") > 0, F.col("slice") / F.col("all")).otherwise(0.0), F.lit(0.0)), F.lit(MOST_HIDDEN))
    return s.groupBy("b", "company", "quarter").agg(F.sum(F.col("win") * share / (1 - share)).alias("hidden"))


# --- scorecard


def validated(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """A many-to-one join that raises if right holds a key twice, or not at all for a row of left."""
    n = right.groupBy(*on).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    once = n.select(*on, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"a key of the right side of the join for {value} is not unique"))).otherwise(F.col(value)).alias(value))
    j = left.join(once.withColumn("_there", F.lit(True)), list(on), "left")
    return j.withColumn(value, F.when(F.col("_there").isNull(), F.raise_error(F.lit(f"no {value} for a row"))).otherwise(F.col(value))).drop("_there")


def scorecard(estimates: DataFrame, truth: DataFrame, pathology: Sequence[int] = ()) -> DataFrame:
    """method, kpi: rows, mean and median error in percent of the truth, share of truths inside the interval, and what the
    mean error of quarters of a pathology exceeds that of the others by. Only scored rows count."""
    d = validated(estimates.where("scored"), truth, ["company", "quarter", "kpi"], "truth").where("truth <> 0")
    ape = 100.0 * F.abs(F.col("estimate") - F.col("truth")) / F.abs("truth")
    inside = F.when(F.col("ci_low").isNotNull(), F.when(F.col("truth").between(F.col("ci_low"), F.col("ci_high")), 1.0).otherwise(0.0))
    bad = F.col("quarter").isin(*pathology) if pathology else F.lit(False)
    g = d.withColumn("ape", ape).groupBy("method", "kpi")
    return g.agg(
        F.count("*").alias("n"), F.avg("ape").alias("mape"), F.median("ape").alias("median_ape"), F.avg(inside).alias("coverage"),
        (F.avg(F.when(bad, F.col("ape"))) - F.avg(F.when(~bad, F.col("ape")))).alias("pathology_cost"),
    )
