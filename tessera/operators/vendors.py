"""Vendor signals from postings, traffic and spend, and how well they foretell what happens to vendors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import stored
from ..functions import columns as C
from . import quality, resolve, signals
from .windows import dense, percentile_rank, trailing, trailing_z

#: Growth of other sources from which a spike counts as real, z-score and floor of a spike, its history.
REAL, SPIKE, FLAT, HISTORY = 0.35, 4.0, 0.10, 6
#: Days within which an equal posting is a relisting.
RELIST = 45
#: Fixed values of levels: the panel's share of spend, employees for an open role, revenue an employee and a visit's worth
#: by segment, with what holds elsewhere.
PANEL_SHARE, STAFF_PER_ROLE, REVENUE_PER_HEAD, VISIT_WORTH = 0.02, 12.0, 220_000.0, 30.0
BANDS = ((0.0, "<1M"), (1e6, "1-3M"), (3e6, "3-10M"), (10e6, "10-30M"), (30e6, "30-100M"), (100e6, ">100M"))
#: Quarters around an event that are searched, rise and fall that count, quarters until a change reaches revenue.
AROUND, CROSS, REALIZED = 4, 15.0, 2


def quarter_of(day: Column, first_year: int = 2022) -> Column:
    """Quarters from 0."""
    return ((F.year(day) - first_year) * 4 + F.quarter(day) - 1).cast("int")


def _grid(of: DataFrame, quarters: int) -> DataFrame:
    return dense(of, of.sparkSession.range(quarters).select(F.col("id").cast("int").alias("quarter")))


def jobs_features(postings: DataFrame, tracked: DataFrame, quarters: int, qa: bool = True) -> DataFrame:
    """vendor, quarter, jobs_tracked, jobs_raw, jobs_n (without relistings), jobs_growth, jobs_freeze and mix, a map of
    function to share. postings: vendor, title, place, posted; tracked: vendor."""
    p = postings.withColumn("fingerprint", C.fingerprint(F.col("title"), F.col("place")))
    raw = p.groupBy("vendor", quarter_of(F.col("posted")).alias("quarter")).agg(F.count("*").alias("jobs_raw"))
    if qa:
        once = quality.relist_collapse(p, ["vendor", "fingerprint"], "posted", RELIST).withColumnRenamed("kept_day", "posted")
    else:
        once = p.select("vendor", "fingerprint", "posted")
    once = once.withColumn("quarter", quarter_of(F.col("posted"))).withColumn("function", C.first_rule(F.substring_index("fingerprint", "|", 1)))
    by = once.groupBy("vendor", "quarter", "function").agg(F.count("*").alias("n"))
    n = by.groupBy("vendor", "quarter").agg(F.sum("n").alias("jobs_n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("function", "n")))).alias("_m"))  # a few functions
    g = _grid(tracked.select("vendor").distinct(), quarters).join(raw, ["vendor", "quarter"], "left").join(n, ["vendor", "quarter"], "left")
    g = g.withColumn("jobs_n", F.coalesce("jobs_n", F.lit(0))).withColumn("jobs_raw", F.coalesce("jobs_raw", F.lit(0)))
    mix = F.transform_values("_m", lambda _, v: v / F.col("jobs_n"))
    return g.select("vendor", "quarter", F.lit(True).alias("jobs_tracked"), "jobs_raw", "jobs_n", signals.smooth_growth("jobs_n", ["vendor"], ["quarter"]).alias("jobs_growth"), signals.frozen("jobs_n", ["vendor"], ["quarter"]).alias("jobs_freeze"), mix.alias("mix"))


def spend_features(spend: DataFrame, known: DataFrame, quarters: int, qa: bool = True, first_year: int = 2022) -> DataFrame:
    """vendor, quarter, spend_amount, spend_count, spend_presence, spend_growth, cliff, each quarter by what was known at its
    own end: a month's rows come out on the first of the next, and names are bridged anew from them.

    spend: descriptor, day, amount, panelist; known: descriptor, vendor. Rows are added up by name, quarter and the quarter
    that they come out in; a quarter's horizon asks for five of these sums, and bridged names carry their horizons, so that the
    feed is read once, whatever the number of quarters, and stored for what names need. A vendor has a row from the first horizon that knows of it within
    five quarters.
    """
    out = quarter_of(F.add_months(F.trunc("day", "MM"), 1), first_year)
    s = spend.select("descriptor", "day", "amount", "panelist").where("descriptor is not null")
    s = (stored(s) if qa else s).withColumns({"since": out, "_of": quarter_of(F.col("day"), first_year)})
    sums = s.groupBy("descriptor", "_of", "since").agg(F.sum("amount").alias("_a"), F.count("*").alias("_n"))
    horizons = F.sequence(F.greatest("since", "_of", F.lit(0)), F.least(F.col("_of") + 4, F.lit(quarters - 1)))
    sums = sums.where((F.greatest("since", "_of") <= F.col("_of") + 4) & (F.greatest("since", "_of") < quarters) & (F.col("_of") + 4 >= 0)).withColumn("quarter", F.explode(horizons))
    own = sums.join(known.select("descriptor", "vendor"), "descriptor")
    if qa:
        found = signals.bridges(s, known, quarters - 1, kept=True).where("horizon >= 1").select("descriptor", F.col("horizon").alias("quarter"), "vendor")
        own = own.unionByName(sums.join(found, ["descriptor", "quarter"]).select(*own.columns))
    back = F.col("quarter") - F.col("_of")
    n = lambda *ks: F.coalesce(F.sum(F.when(back.isin(*ks), F.col("_n"))), F.lit(0))
    g = own.groupBy("vendor", "quarter").agg(
        F.sum(F.when(back == 0, F.col("_a"))).alias("_now"), F.sum(F.when(back == 1, F.col("_a"))).alias("_before"), n(0).alias("spend_count"), n(0, 1).alias("_two"), n(1, 2, 3, 4).alias("_past"),
    )
    mean = F.col("_past") / F.greatest(F.lit(1), F.least(F.lit(4), F.col("quarter")))
    presence = signals.presence(F.col("_two"))
    growth = F.when(presence == "present", C.log_growth(F.col("_now"), F.col("_before")))
    return g.select("vendor", "quarter", F.coalesce("_now", F.lit(0.0)).alias("spend_amount"), "spend_count", presence.alias("spend_presence"), growth.alias("spend_growth"), ((mean > 0) & (F.col("spend_count") < 0.5 * mean)).alias("cliff"))


def spikes(web: DataFrame, others: DataFrame | None, by: Sequence[str] = ("vendor",), month: str = "month", value: str = "visits") -> DataFrame:
    """web with spike: a monthly log return far above the six before it, in a quarter in which no other source moved.

    others: by, quarter and growths of other sources (null: no move); without it every spike stands.
    """
    w = W.partitionBy(*by).orderBy(month)
    x = web.withColumn("_r", F.log(F.greatest(F.col(value), F.lit(1)).cast("double")) - F.log(F.greatest(F.lag(value).over(w), F.lit(1)).cast("double")))
    full = trailing(F.count("_r"), list(by), [month], HISTORY) == HISTORY
    x = x.withColumn("spike", F.coalesce(full & (trailing_z("_r", list(by), [month], HISTORY, floor=FLAT) > SPIKE), F.lit(False))).drop("_r")
    if others is not None:
        growths = [c for c in others.columns if c not in (*by, "quarter")]
        x = x.withColumn("quarter", F.floor(F.col(month) / 3).cast("int")).join(others, [*by, "quarter"], "left")
        still = reduce(lambda a, b: a & b, [F.abs(F.coalesce(F.col(g), F.lit(0.0))) < REAL for g in growths])
        x = x.withColumn("spike", F.col("spike") & still).drop(*growths, "quarter")
    return x


def web_features(web: DataFrame, others: DataFrame | None, covered: DataFrame, quarters: int, qa: bool = True) -> DataFrame:
    """vendor, quarter, web_visits, web_months, web_growth: mean log visits of the months seen against those of the quarter
    before, spikes winsorized first. web: vendor, month (from 0), visits."""
    x = spikes(web, others) if qa else web.withColumn("spike", F.lit(False))
    x = x.withColumn("visits", quality.winsorized("visits", F.col("spike"), ["vendor"], ["month"]).cast("double")).withColumn("quarter", F.floor(F.col("month") / 3).cast("int"))
    q = x.groupBy("vendor", "quarter").agg(F.sum("visits").alias("web_visits"), F.count("*").alias("web_months"), F.avg(F.log(F.greatest("visits", F.lit(1.0)))).alias("_l"))
    g = _grid(covered.select("vendor").distinct(), quarters).join(q, ["vendor", "quarter"], "left")
    growth = F.col("_l") - F.lag("_l").over(W.partitionBy("vendor").orderBy("quarter"))
    return g.select("vendor", "quarter", F.coalesce("web_visits", F.lit(0.0)).alias("web_visits"), F.coalesce("web_months", F.lit(0)).alias("web_months"), growth.alias("web_growth"))


def source_growth(jobs: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """vendor, quarter, and log growths of raw postings and of resolved spend, for the corroboration of spikes."""
    w = W.partitionBy("vendor").orderBy("quarter")
    g = jobs.select("vendor", "quarter", C.log_growth(F.col("jobs_raw").cast("double"), F.lag("jobs_raw").over(w).cast("double")).alias("_jobs"))
    return g if spend is None else g.join(spend.select("vendor", "quarter", F.col("spend_growth").alias("_spend")), ["vendor", "quarter"], "full")


def scored(jobs: DataFrame, web: DataFrame, spend: DataFrame, segments: DataFrame, weights: dict[str, float] = signals.WEIGHTS) -> DataFrame:
    """All features of the three sources joined (a row where any has one), coverage, percentiles, composite and flags."""
    d = jobs.join(web, ["vendor", "quarter"], "full").join(spend, ["vendor", "quarter"], "full").join(segments.select("vendor", "segment"), "vendor")
    d = signals.coverage(d, ["vendor"], ["quarter"])
    d = d.withColumn("jobs_growth", F.when(F.col("jobs_status") != "untracked", F.col("jobs_growth")))
    return signals.flags(signals.composite(d, ["segment", "quarter"], weights), ["vendor"], ["quarter"])


def levels(df: DataFrame, heads: dict[str, float] | None = None, worth: dict[str, float] | None = None) -> DataFrame:
    """Adds estimate, level_band and level_method: yearly revenue from spend if present, else from postings if tracked, else
    from traffic; without any of them no_data."""
    by = lambda of, default: reduce(lambda e, kv: F.when(F.col("segment") == kv[0], kv[1]).otherwise(e), (of or {}).items(), F.lit(default))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    spend = (F.col("spend_presence") == "present") & (zero("spend_amount") > 0)
    jobs, web = F.col("jobs_status").isin("tracked_active", "tracked_zero"), F.col("web_status") == "present"
    estimate = F.when(spend, zero("spend_amount") * 4 / PANEL_SHARE).when(jobs, zero("jobs_n") * STAFF_PER_ROLE * by(heads, REVENUE_PER_HEAD)).when(web, zero("web_visits") * 4 * by(worth, VISIT_WORTH))
    method = F.when(spend, "spend").when(jobs, "jobs").when(web, "web").otherwise("none")
    d = df.withColumn("estimate", estimate).withColumn("level_method", method)
    return d.withColumn("level_band", F.when(F.col("estimate").isNull(), "no_data").otherwise(C.band(F.col("estimate"), list(BANDS))))


# --- against what happened


def event_study(events: DataFrame, df: DataFrame, sources: Sequence[str], last: int) -> DataFrame:
    """vendor, quarter, type, source, present, detected, lead, lead_revenue: when each source's percentile first crossed its
    mean of the two quarters before by the limit, within four quarters of an event.

    events: vendor, quarter, type. The two quarters before must lie in the window too, so the earliest crossing is two
    quarters into it. A vendor without any scored quarter has no rows.
    """
    long = df.unpivot(["vendor", "quarter"], list(sources), "source", "pct").withColumnRenamed("quarter", "q")
    w = W.partitionBy("vendor", "source").orderBy("q")
    a, b = F.lag("pct", 1).over(w), F.lag("pct", 2).over(w)
    whole = (F.lag("q", 1).over(w) == F.col("q") - 1) & (F.lag("q", 2).over(w) == F.col("q") - 2)
    long = long.withColumn("delta", F.when(whole, F.col("pct") - (a + b) / 2))
    low, high = F.greatest(F.lit(0), F.col("quarter") - AROUND), F.least(F.lit(last), F.col("quarter") + AROUND)
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sources))).alias("source"))
    known = events.join(df.select("vendor").distinct(), "vendor", "left_semi").crossJoin(names)  # a few sources
    j = known.join(long, ["vendor", "source"], "left")
    inside = F.col("q").between(low, high)
    hit = inside & (F.col("q") >= low + 2) & F.when(F.col("type") == "acceleration", F.col("delta") >= CROSS).otherwise(F.col("delta") <= -CROSS)
    g = j.groupBy("vendor", "quarter", "type", "source").agg(F.coalesce(F.max(inside & F.col("pct").isNotNull()), F.lit(False)).alias("present"), F.min(F.when(hit, F.col("q"))).alias("detected"))
    return g.withColumn("lead", F.col("quarter") - F.col("detected")).withColumn("lead_revenue", F.col("quarter") + REALIZED - F.col("detected"))


def event_summary(study: DataFrame) -> DataFrame:
    """By source and type: events, those with the source, detected ones, rate, median and quartiles of leads."""
    there = study.groupBy("source", "type")
    hit = F.col("present") & F.col("detected").isNotNull()
    lead = F.when(hit, F.col("lead"))
    g = there.agg(F.count("*").alias("n_events"), F.count_if("present").alias("n_present"), F.count_if(hit).alias("n_detected"), F.median(lead).alias("median_lead"), F.percentile(lead, 0.25).alias("lead_q1"), F.percentile(lead, 0.75).alias("lead_q3"), F.median(F.when(hit, F.col("lead_revenue"))).alias("median_lead_revenue"))
    return g.withColumn("detection_rate", F.when(F.col("n_present") > 0, F.col("n_detected") / F.col("n_present")))


def inflection_grid(df: DataFrame, events: DataFrame, ks: Sequence[int] = (1, 2)) -> DataFrame:
    """k, type, tier, n_flags, n_events, precision, recall of flags against events, matched one to one within k quarters.
    Events without a scored quarter count in tier C."""
    at = F.array_compact(F.array(F.when(F.col("accel_flag"), F.lit("acceleration")), F.when(F.col("stall_flag"), F.lit("stall"))))
    flags = df.select("vendor", F.explode(at).alias("type"), F.col("quarter").cast("long").alias("period"), "tier")
    e = events.select("vendor", "type", F.col("quarter").cast("long").alias("period")).join(df.select("vendor", F.col("quarter").cast("long").alias("period"), F.col("tier").alias("_t")), ["vendor", "period"], "left")
    e = e.withColumn("tier", F.coalesce("_t", F.lit("C"))).drop("_t")
    parts = []
    for k in ks:
        m = resolve.greedy_match(e, flags, ["vendor", "type"], k).where("flag_period is not null").select("vendor", "type", "event_period", "flag_period")
        f = flags.join(m.select("vendor", "type", F.col("flag_period").alias("period"), F.lit(1).alias("hit")).distinct(), ["vendor", "type", "period"], "left")
        v = e.join(m.select("vendor", "type", F.col("event_period").alias("period"), F.lit(1).alias("hit")).distinct(), ["vendor", "type", "period"], "left")
        f = f.groupBy("type", "tier").agg(F.count("*").alias("n_flags"), F.count("hit").alias("_fh"))
        v = v.groupBy("type", "tier").agg(F.count("*").alias("n_events"), F.count("hit").alias("_eh"))
        parts.append(f.join(v, ["type", "tier"], "full").withColumn("k", F.lit(k)))
    cells = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k")).crossJoin(df.sparkSession.range(1).select(F.explode(F.array(F.lit("acceleration"), F.lit("stall"))).alias("type"))).crossJoin(df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, "ABC"))).alias("tier")))  # a fixed dozen
    g = cells.join(reduce(DataFrame.unionByName, parts), ["k", "type", "tier"], "left").fillna(0, ["n_flags", "n_events", "_fh", "_eh"])
    return g.select("k", "type", "tier", "n_flags", "n_events", F.when(F.col("n_flags") > 0, F.col("_fh") / F.col("n_flags")).alias("precision"), F.when(F.col("n_events") > 0, F.col("_eh") / F.col("n_events")).alias("recall"))


def rank_quality(df: DataFrame, facts: DataFrame, least: int = 5) -> DataFrame:
    """quarter, cut, key, n, spearman of composite and the growth of value to the next quarter: over all vendors, by tier
    and by segment; null below least vendors. facts: vendor, quarter, value."""
    w = W.partitionBy("vendor").orderBy("quarter")
    ahead = F.when(F.lead("quarter").over(w) == F.col("quarter") + 1, F.lead("value").over(w))
    growth = facts.select("vendor", "quarter", F.when(F.col("value") != 0, (ahead - F.col("value")) / F.col("value")).alias("growth")).where("growth is not null")
    cut = lambda c, k: F.struct(F.lit(c).alias("cut"), k.alias("key"))
    j = df.select("vendor", "quarter", "composite", F.explode(F.array(cut("blended", F.lit("ALL")), cut("tier", F.col("tier")), cut("segment", F.col("segment")))).alias("x")).join(growth, ["vendor", "quarter"])
    j = j.select("quarter", "x.cut", "x.key", "composite", "growth").where("composite is not null")
    by = ["quarter", "cut", "key"]
    r = j.select(*by, percentile_rank("composite", by).alias("a"), percentile_rank("growth", by).alias("b"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("a", "b")).alias("spearman"))


def rank_summary(q: DataFrame) -> DataFrame:
    return q.groupBy("cut", "key").agg(F.median("spearman").alias("median_spearman"), F.count("*").alias("n_quarters"))


def shutdown_validation(df: DataFrame, events: DataFrame) -> DataFrame:
    """One row: shutdowns, those scored two quarters before, the share of them in the bottom quarter of composites then, the
    median composite a quarter before, the population's, and how many stood above 50 a quarter before."""
    of = events.where("event = 'shutdown'").select("vendor", F.col("quarter").alias("_q"))
    low = df.groupBy("quarter").agg(F.percentile("composite", 0.25).alias("_low"))
    d = df.select("vendor", "quarter", "composite").join(low, "quarter")
    at = lambda k: d.select("vendor", (F.col("quarter") + k).alias("_q"), F.col("composite").alias(f"_c{k}"), F.col("_low").alias(f"_low{k}"))
    j = of.join(at(1), ["vendor", "_q"], "left").join(at(2), ["vendor", "_q"], "left")
    r = j.agg(F.count("*").alias("n_shutdowns"), F.count("_c2").alias("n_scored"), F.avg(F.when(F.col("_c2").isNotNull(), (F.col("_c2") <= F.col("_low2")).cast("int"))).alias("bottom_quartile_share"), F.median("_c1").alias("median_before"), F.count_if(F.col("_c1") > 50).alias("n_above_50"))
    return r.crossJoin(df.agg(F.median("composite").alias("population_median")))


def funding_validation(df: DataFrame, events: DataFrame) -> DataFrame:
    """One row: funding events, those scored a quarter before, their median composite then and the population's."""
    of = events.where("event = 'funding'").select("vendor", F.col("quarter").alias("_q"))
    j = of.join(df.select("vendor", (F.col("quarter") + 1).alias("_q"), "composite"), ["vendor", "_q"], "left")
    return j.agg(F.count("*").alias("n_fundings"), F.count("composite").alias("n_scored"), F.median("composite").alias("median_before")).crossJoin(df.agg(F.median("composite").alias("population_median")))


def acquisition_validation(leveled: DataFrame, disclosed: DataFrame) -> DataFrame:
    """vendor, quarter, disclosed, estimate_m, band, true_band, band_hit, within_one, log_error of disclosed revenues (in
    millions, at the quarter of the acquisition, the last in which the vendor can be seen); quarters without data go."""
    names = F.array(*[F.lit(n) for _, n in BANDS])
    place = lambda c: F.array_position(names, F.col(c))
    j = disclosed.join(leveled.where("estimate is not null").select("vendor", "quarter", (F.col("estimate") / 1e6).alias("estimate_m"), F.col("level_band").alias("band")), ["vendor", "quarter"])
    j = j.withColumn("true_band", C.band(F.col("disclosed") * 1e6, list(BANDS)))
    safe = lambda c: F.log10(F.greatest(F.col(c), F.lit(0.01)))
    return j.withColumn("band_hit", F.col("band") == F.col("true_band")).withColumn("within_one", F.abs(place("band") - place("true_band")) <= 1).withColumn("log_error", F.abs(safe("estimate_m") - safe("disclosed")))


def threshold_strip(df: DataFrame, events: DataFrame, thresholds: Sequence[float] = (10.0, 15.0, 20.0), k: int = 2) -> DataFrame:
    """threshold, n_flags, precision, recall over all types and tiers when flags need more or less of a change."""
    parts = []
    for x in thresholds:
        f = signals.flags(df.drop("delta", "accel_flag", "stall_flag"), ["vendor"], ["quarter"], rise=x, fall=-x)
        g = inflection_grid(f, events, (k,))
        hits = lambda n, r: F.sum(F.coalesce(F.col(r), F.lit(0.0)) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
        parts.append(g.agg(F.sum("n_flags").alias("n_flags"), hits("n_flags", "precision").alias("precision"), hits("n_events", "recall").alias("recall")).select(F.lit(float(x)).alias("threshold"), "n_flags", "precision", "recall"))
    return reduce(DataFrame.unionByName, parts)

