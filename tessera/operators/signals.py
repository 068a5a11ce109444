"""Signals of a vendor by period from several sources: growth, presence, coverage, composite, flags, bridged names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import durable, looked_up, stored
from .order import quantiles, sums_before
from .windows import both_before, percentile_rank

#: Rows in two periods from which a source is present, weights of sources, shrinkage of the lowest tier.
PRESENT, WEIGHTS, SHRINK = 8, {"jobs": 0.35, "web": 0.20, "spend": 0.45}, 0.5

#: Rise and level of an acceleration, fall and level of a stall.
RISE, FLOOR, FALL, CEILING = 15.0, 55.0, -15.0, 45.0

#: Fading of a known name; overlap, amount and cadence of its successor.
FADE, OVERLAP, AMOUNT, CADENCE = 0.7, 0.5, 0.6, (0.8, 1.25)


def smooth_growth(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Log growth, plus one, of the mean of two periods over the two before; null before the fourth period."""
    w = W.partitionBy(*by).orderBy(*order)
    back = lambda k: F.lag(value, k).over(w)
    return F.log((F.col(value) + back(1)) / 2 + 1) - F.log((back(2) + back(3)) / 2 + 1)


def frozen(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Two periods of nothing after any activity."""
    w = W.partitionBy(*by).orderBy(*order)
    before = F.max(F.col(value) > 0).over(w.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(before & (F.col(value) == 0) & (F.lag(value).over(w) == 0), F.lit(False))


def at_own_horizon(facts: DataFrame, by: Sequence[str], period: str, seen: str, amount: str) -> DataFrame:
    """Per key and period p: rows and amounts of p and of p - 1, each as far as known at the end of p.

    A fact of period p is known from its period `seen` on. A period asks only for what was known at its own end and at
    the end of the next one, so one aggregation holds all horizons and no fact meets all periods.
    """
    now, later = F.col(seen) <= F.col(period), F.col(seen) <= F.col(period) + 1
    cents = F.col(amount).cast("decimal(18,2)")
    g = facts.groupBy(*by, period).agg(
        F.count_if(now).alias("n_now"), F.count_if(later).alias("_n"), F.coalesce(F.sum(F.when(now, cents)), F.lit(0)).cast("double").alias("amount_now"), F.coalesce(F.sum(F.when(later, cents)), F.lit(0)).cast("double").alias("_a"),
    )
    before = F.struct(F.lit(0).cast("bigint").alias("n_now"), F.lit(0.0).alias("amount_now"), F.col("_n").alias("n_before"), F.col("_a").alias("amount_before"), (F.col(period) + 1).alias(period))
    own = F.struct("n_now", "amount_now", F.lit(0).cast("bigint").alias("n_before"), F.lit(0.0).alias("amount_before"), F.col(period).alias(period))
    both = g.select(*by, F.explode(F.array(own, before)).alias("x")).select(*by, "x.*")
    return both.groupBy(*by, period).agg(*[F.sum(c).alias(c) for c in ("n_now", "n_before", "amount_now", "amount_before")])


def presence(n_trailing: Column, least: int = PRESENT) -> Column:
    return F.when(n_trailing >= least, "present").when(n_trailing > 0, "thin").otherwise("absent")


def coverage(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds jobs_status, web_status, tier and tier_reason to rows with jobs_tracked, jobs_n, web_months, spend_presence, cliff.

    A tracked vendor without postings counts as covered, a thin source does not. The first period in which all sources
    are silent after any was present overrides the reason.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = df.withColumn("jobs_status", F.when(~on("jobs_tracked"), "untracked").when(F.col("jobs_n") > 0, "tracked_active").otherwise("tracked_zero"))
    d = d.withColumn("web_status", F.when(F.col("web_months") > 0, "present").otherwise("absent")).withColumn("spend_presence", F.coalesce("spend_presence", F.lit("absent")))
    jobs, web, spend = F.col("jobs_status") != "untracked", F.col("web_status") == "present", F.col("spend_presence") == "present"
    d = d.withColumn("_any", (F.col("jobs_status") == "tracked_active") | web | spend)
    dark = ~F.col("_any") & F.coalesce(F.lag("_any").over(W.partitionBy(*by).orderBy(*order)), F.lit(False))
    reason = (
        F.when(dark, "post_shutdown_dark").when(jobs & web & spend, "full").when(~spend & ~on("cliff"), "no_spend_channel").when(~web, "below_traffic_floor")
        .when(~jobs, "untracked_jobs").when(on("cliff"), "coverage_cliff").otherwise("no_spend_channel")
    )
    n = jobs.cast("int") + web.cast("int") + spend.cast("int")
    return d.withColumn("tier_reason", reason).withColumn("tier", F.when(n == 3, "A").when(n == 2, "B").otherwise("C")).drop("_any")


def composite(df: DataFrame, group: Sequence[str], sources: dict[str, float] = WEIGHTS, tier: str = "tier") -> DataFrame:
    """Adds <source>_pct and composite: the mean of the percentiles that are there, by weight; none gives 50. The lowest
    tier is drawn half way to 50. Growth columns are <source>_growth, null where the source is not present."""
    for s in sources:
        df = df.withColumn(f"{s}_pct", percentile_rank(f"{s}_growth", group))
    pct = {s: F.col(f"{s}_pct") for s in sources}
    total = sum((F.when(p.isNotNull(), w * p).otherwise(F.lit(0.0)) for w, p in ((sources[s], pct[s]) for s in sources)), F.lit(0.0))
    weight = sum((F.when(pct[s].isNotNull(), F.lit(sources[s])).otherwise(F.lit(0.0)) for s in sources), F.lit(0.0))
    raw = F.when(weight > 0, total / weight).otherwise(F.lit(50.0))
    return df.withColumn("composite", F.when(F.col(tier) == "C", 50 + SHRINK * (raw - 50)).otherwise(raw))


def flags(df: DataFrame, by: Sequence[str], order: Sequence[str], rise: float = RISE, floor: float = FLOOR, fall: float = FALL, ceiling: float = CEILING) -> DataFrame:
    """Adds delta (against the mean of the two rows before), accel_flag and stall_flag; without two rows before no flag."""
    d = df.withColumn("delta", F.col("composite") - both_before("composite", by, order))
    accel = F.coalesce((F.col("delta") >= rise) & (F.col("composite") >= floor), F.lit(False))
    return d.withColumn("accel_flag", accel).withColumn("stall_flag", F.coalesce(~accel & (F.col("delta") <= fall) & (F.col("composite") <= ceiling), F.lit(False)))


def sensitivity(df: DataFrame, by: Sequence[str], order: Sequence[str], thresholds: Sequence[float] = (10.0, 15.0, 20.0)) -> DataFrame:
    """Numbers of flags by threshold, from one scan: the thresholds are a short list."""
    d = df.withColumn("delta", F.col("composite") - both_before("composite", by, order))
    at = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    g = d.select("delta", "composite", at).groupBy("threshold")
    return g.agg(F.count_if((F.col("delta") >= F.col("threshold")) & (F.col("composite") >= FLOOR)).alias("n_accel"), F.count_if((F.col("delta") <= -F.col("threshold")) & (F.col("composite") <= CEILING)).alias("n_stall"))


def _cell(value: Column, ratio: float) -> Column:
    """Cells of a logarithmic scale so wide that two values within the ratio lie in one cell or in neighbouring ones."""
    return F.floor(F.log(value) / (1.0001 * math.log(ratio)))


def overlapping(left: DataFrame, right: DataFrame, share: float, fits: Sequence[tuple[str, str, float, float]] = ()) -> DataFrame:
    """(left, right, n, people): pairs of sets of which the right one has more than a share of its members in the left one.

    left: left, member; right: right, member; both distinct, and with the numeric columns that fits names: (left column,
    right column, low, high) admits pairs whose right value is low to high times the left one; values that are not positive fit
    nothing. n: members shared, people: members of the right set.

    A join by prefix: if a pair shares at least k of a right set's p members, it shares one of any p - k + 1 of them, so only
    those that are rarest on the left are looked up, beside the cells of the values. A member that is in thousands of sets is
    hardly ever looked up, and then in its cells only. What is found is counted exactly. Members are ranked by two passes, so
    a set of any size is spread over tasks.
    """
    a, b = [f[0] for f in fits], [f[1] for f in fits]
    positive = lambda df, cs: df.where(reduce(lambda x, y: x & y, (F.col(c) > 0 for c in cs), F.lit(True)))
    left, right = positive(left, a), positive(right, b)
    size = right.groupBy("right").agg(F.count("*").alias("people")).withColumn("_need", F.floor(F.col("people") * share) + 1)
    common = left.groupBy("member").agg(F.count("*").alias("_common"))
    ranked = right.join(common, "member", "left").select("right", F.struct(F.coalesce("_common", F.lit(0)).alias("common"), "member").alias("_at"), F.lit(1).cast("long").alias("_one"), *b)
    ranked = sums_before(ranked, ["right"], "_at", "_one").where("_at.common > 0")
    prefix = ranked.join(size, "right").where(F.col("before") <= F.col("people") - F.col("_need")).select("right", F.col("_at.member").alias("member"), *b)
    on = ["member"]
    for k, (x, y, low, high) in enumerate(fits):
        wide = max(high, 1 / low)
        left = left.withColumn(f"_c{k}", _cell(F.col(x), wide))
        prefix = prefix.withColumn(f"_c{k}", F.explode(F.array(*[_cell(F.col(y), wide) + i for i in (-1, 0, 1)])))
        on.append(f"_c{k}")
    found = prefix.join(left, on)
    for x, y, low, high in fits:
        found = found.where((F.col(y) / F.col(x)).between(low, high))
    pairs = found.select("left", "right").distinct()
    shared = pairs.join(right.select("right", "member"), "right").join(left.select("left", "member"), ["left", "member"])
    return shared.groupBy("left", "right").agg(F.count("*").alias("n")).join(size, "right").where("n >= _need").select("left", "right", "n", "people")


def bridges(facts: DataFrame, known: DataFrame, last: int, kept: bool = False) -> DataFrame:
    """(horizon, descriptor, vendor, overlap, amount_ratio, cadence_ratio): at each horizon up to last the unknown descriptors that
    take over from a fading vendor, by the facts known then.

    facts: descriptor, panelist, day, amount, since (the horizon from which it is known); known: descriptor, vendor. A vendor
    fades when its last month holds at most seven tenths of the mean of its months before. Of several vendors that fit the
    first by id claims a name. Null names and panelists count for nothing.

    Facts are read once and stored, unless they are kept already (cheap to read again). What a horizon adds to is state: rows and
    days by name and month, first sightings of panelists; a fact enters at its own horizon and stays. Names of vendors are joined
    to the state, not to the facts. Amounts are looked at only of names and horizons with both a fading vendor and a new name.
    """
    facts = facts.where("descriptor is not null and panelist is not null").select("descriptor", "panelist", "day", "amount", F.col("since").cast("int").alias("since")).where(F.col("since") <= last)
    facts = facts if kept else stored(facts)
    known = known.select("descriptor", "vendor")
    state = facts.groupBy("descriptor", F.trunc("day", "MM").alias("month"), "since").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("final"))
    state, seen = (durable(x.join(known, "descriptor", "left")) for x in (state, facts.groupBy("descriptor", "panelist").agg(F.min("since").alias("since"))))
    owned = lambda df: df.where("vendor is not null").withColumn("name", F.col("vendor"))
    others = lambda df: df.where("vendor is null").withColumn("name", F.col("descriptor"))
    onward = F.explode(F.sequence(F.greatest("since", F.lit(0)), F.lit(last))).alias("horizon")
    key = ["horizon", "name"]

    months = owned(state).groupBy("name", "month", "since").agg(F.sum("n").alias("n")).select("name", "month", "n", onward)
    months = months.groupBy(*key, "month").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.max_by("n", "month").alias("last"), F.sum("n").alias("all"), F.count("*").alias("k"))
    fading = months.where((F.col("k") >= 2) & (F.col("last") <= FADE * (F.col("all") - F.col("last")) / (F.col("k") - 1))).select(*key)
    fresh = others(state).groupBy("name").agg(F.min("since").alias("since")).select("name", onward)
    fading = durable(fading.join(fresh.select("horizon").distinct(), "horizon", "left_semi"))
    fresh = durable(fresh.join(fading.select("horizon").distinct(), "horizon", "left_semi"))

    def stats(df: DataFrame, of: DataFrame, p: str) -> DataFrame:
        days = df.select("name", "n", "first", "final", onward).join(of, key)
        gap = F.datediff(F.max("final"), F.min("first")) / F.when(F.sum("n") > 1, F.sum("n") - 1)
        at = looked_up(df.select("descriptor", "name").distinct().join(of.groupBy("name").agg(F.collect_set("horizon").alias("at")), "name"))
        # a fact enters at the first horizon that asks for its name
        enter = F.array_min(F.filter("at", lambda h: h >= F.col("since")))
        mid = quantiles(facts.join(at, "descriptor").select("name", "amount", enter.alias("enter")), ["name"], "amount", {f"{p}_mid": 0.5}, "enter", last, of)
        return durable(mid.join(days.groupBy(*key).agg(gap.alias(f"{p}_cadence")), key))

    def side(df: DataFrame, of: DataFrame, name: str) -> DataFrame:
        first = df.groupBy("name", "panelist").agg(F.min("since").alias("since")).select("name", "panelist", onward).join(of, key)
        return first.withColumns({name: F.struct(*key), "member": F.struct("horizon", "panelist")}).drop(*key, "panelist")

    a, b = stats(owned(state), fading, "a"), stats(others(state), fresh, "b")
    left, right = side(owned(seen), a, "left"), side(others(seen), b, "right")
    pairs = overlapping(left, right, OVERLAP, [("a_mid", "b_mid", 0.999 * AMOUNT, 1.001 / AMOUNT), ("a_cadence", "b_cadence", *CADENCE)])
    x = pairs.select("left.horizon", F.col("left.name").alias("vendor"), F.col("right.name").alias("descriptor"), (F.col("n") / F.col("people")).alias("overlap"))
    x = x.join(a.withColumnRenamed("name", "vendor"), ["horizon", "vendor"]).join(b.withColumnRenamed("name", "descriptor"), ["horizon", "descriptor"])
    x = x.withColumn("amount_ratio", F.least("a_mid", "b_mid") / F.greatest("a_mid", "b_mid")).withColumn("cadence_ratio", F.col("b_cadence") / F.col("a_cadence"))
    fit = x.where((F.col("amount_ratio") >= AMOUNT) & F.col("cadence_ratio").between(*CADENCE))
    return fit.groupBy("horizon", "descriptor").agg(F.min_by(F.struct("vendor", "overlap", "amount_ratio", "cadence_ratio"), "vendor").alias("m")).select("horizon", "descriptor", "m.*")


def bridge(facts: DataFrame, known: DataFrame) -> DataFrame:
    """bridges() by all facts (descriptor, panelist, day, amount) at once, without a horizon."""
    return bridges(facts.withColumn("since", F.lit(0)), known, 0).drop("horizon")
