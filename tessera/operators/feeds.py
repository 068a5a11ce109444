"""Detectors and repairs of transaction feeds: doubled days, recruitment waves, outages, renamed merchants, hard checks.

Days, months and companies are calendars and dictionaries; whatever grows with the rows is aggregated to them first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quality
from .windows import dense, islands, trailing_z

#: Share of extra copies of a doubled day, days of its history.
DOUBLED, HISTORY_DAYS = 0.20, 28
#: Share of newcomers and shift of composition of a wave, months of its history.
NEWCOMERS, SHIFT, HISTORY_MONTHS = 0.05, 0.06, 3
#: Silent days of an outage, rows a day of an instrument that is watched, days of history that it needs.
SILENT, WATCHED, KNOWN_DAYS = 3, 30, 7
#: What is left of a collapsed name, rows a month it had before, months of history it needs.
LEFT, MONTHLY, KNOWN_MONTHS = 0.25, 50, 6
#: Of a successor: share of the lost volume, gap of median amounts, overlap of panelists, cadence.
VOLUME, GAP, SHARED, CADENCE = 0.30, 0.25, 0.30, (0.5, 2.0)
#: Points by which a weekly rate falls below the mean of the weeks before, and how many those are.
DRIFT, DRIFT_WEEKS = 0.03, 3


def doubled_days(df: DataFrame, content: Sequence[str], day: str, share: float = DOUBLED, history: int = HISTORY_DAYS) -> DataFrame:
    """Per day: rows, extra copies of equal content, their share, the z-score of the volume, and whether the day is doubled."""
    d = quality.duplicate_share(df, content, day)
    # one window over the days seen: a calendar
    return d.withColumn("volume_z", trailing_z("n_rows", [], [day], history)).withColumn("doubled", F.col("extra_share") > share)


def recruitment_waves(panelists: DataFrame, months: int, newcomers: float = NEWCOMERS, shift: float = SHIFT) -> DataFrame:
    """Per month from the second on: joins, their share of the panel before, the distance of the panel's composition from
    its mean over three months before, and whether both are large. panelists: cell, joined, left (0: never)."""
    spells = panelists.groupBy("cell", "joined", "left").agg(F.count("*").alias("n"))
    calendar = panelists.sparkSession.range(1, months + 1).select(F.col("id").cast("int").alias("month"))
    here = (F.col("joined") <= F.col("month")) & ((F.col("left") == 0) | (F.col("left") > F.col("month")))
    g = dense(spells, calendar).groupBy("month", "cell").agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("joined") == F.col("month"), F.col("n")).otherwise(0)).alias("new"))
    g = g.withColumn("share", F.col("n") / F.greatest(F.lit(1), F.sum("n").over(W.partitionBy("month"))))
    before = F.avg("share").over(W.partitionBy("cell").orderBy("month").rowsBetween(-HISTORY_MONTHS, -1))
    m = g.withColumn("before", before).groupBy("month").agg(F.sum("new").alias("joins"), F.sum("n").alias("n"), F.coalesce(F.sum(F.abs(F.col("share") - F.col("before"))), F.lit(0.0)).alias("composition_l1"))
    m = m.withColumn("join_share", F.col("joins") / F.greatest(F.lit(1), F.coalesce(F.lag("n").over(W.orderBy("month")), F.lit(0)))).where("month >= 2")
    return m.select("month", "joins", "join_share", "composition_l1", ((F.col("join_share") > newcomers) & (F.col("composition_l1") > shift)).alias("wave"))


def outages(df: DataFrame, instrument: str, day: str, silent: int = SILENT, watched: float = WATCHED, history: int = HISTORY_DAYS, known: int = KNOWN_DAYS) -> DataFrame:
    """(instrument, first, last, length): runs of silent days of an instrument whose days before were busy.

    A day counts as silent if the feed has it but not the instrument, which has a week of days before and, on those of
    the last 28 on which it was seen, more rows in the mean than the least.
    """
    n = df.groupBy(instrument, day).agg(F.count("*").alias("n"))
    g = dense(n.select(instrument).distinct(), n.select(day).distinct()).join(n, [instrument, day], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(instrument).orderBy(day).rowsBetween(-history, -1)
    mean = F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))).over(w), F.lit(0.0))
    g = g.withColumn("_silent", (F.col("n") == 0) & (F.count("*").over(w) >= known) & (mean > watched))
    return islands(g, "_silent", [instrument], day).where(F.col("length") >= silent)


def renamed(df: DataFrame, companies: DataFrame, months: int, monthly: float = MONTHLY) -> DataFrame:
    """(old_core, new_core, company, month, amount_gap, overlap, cadence_ratio): unknown names that take over from known
    ones whose volume collapses.

    df: core, month, panelist, amount; companies: core, company. Only a known name's first collapse is judged. Of several
    that lose to one new name, the first by its core claims it.
    """
    n = df.groupBy("core", "month").agg(F.count("*").alias("n"))
    calendar = df.sparkSession.range(1, months + 1).select(F.col("id").cast("int").alias("month"))
    v = dense(companies.select("core"), calendar).join(n, ["core", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy("core").orderBy("month")
    v = v.withColumn("all", F.avg("n").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("trail", F.avg("n").over(w.rowsBetween(-3, -1)))
    fell = v.where((F.col("month") > KNOWN_MONTHS) & (F.col("all") >= monthly) & (F.col("trail") > 0) & (F.col("n") < LEFT * F.col("trail")))
    fell = fell.groupBy("core").agg(F.min_by(F.struct("month", (F.col("trail") - F.col("n")).alias("lost")), "month").alias("x")).select(F.col("core").alias("old_core"), "x.month", "x.lost")
    unknown = n.join(companies.select("core"), "core", "left_anti")
    first = unknown.groupBy("core").agg(F.min("month").alias("since"), F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by_month"))  # a name's months: a calendar
    # a name that changes within a month is new in the month before its predecessor's collapse
    near = fell.select("*", F.explode(F.array("month", F.col("month") - 1)).alias("since"))
    pairs = near.join(first, "since").where(F.coalesce(F.try_element_at("by_month", F.col("month")), F.lit(0)) >= VOLUME * F.col("lost")).select("old_core", F.col("core").alias("new_core"), "month", "since")
    old = df.join(pairs, F.col("core") == F.col("old_core")).where(df["month"] < F.col("since"))
    recent = df["month"] >= pairs["month"] - 6
    old = old.select("old_core", "new_core", "panelist", "amount", df["month"].alias("m"), recent.alias("recent"))
    new = df.join(pairs, F.col("core") == F.col("new_core")).where(df["month"].between(pairs["month"] - 1, pairs["month"] + 1)).select("old_core", "new_core", "panelist", "amount", df["month"].alias("m"))
    key = ["old_core", "new_core"]
    a = old.groupBy(*key).agg(F.median("amount").alias("mid_old"), F.count_if("recent").alias("rows_old"), F.count_distinct(F.when(F.col("recent"), F.struct("panelist", "m"))).alias("months_old"))
    b = new.groupBy(*key).agg(F.median("amount").alias("mid_new"), F.count("*").alias("rows_new"), F.count_distinct(F.struct("panelist", "m")).alias("months_new"), F.count_distinct("panelist").alias("people"))
    both = new.select(*key, "panelist").distinct().join(old.where("recent").select(*key, "panelist").distinct(), [*key, "panelist"]).groupBy(*key).agg(F.count("*").alias("shared"))
    cadence_old = F.col("rows_old") / F.greatest(F.lit(1), F.col("months_old"))
    e = pairs.select(*key, "month").join(a, key).join(b, key).join(both, key, "left").select(
        *key, "month", (F.abs(F.col("mid_new") - F.col("mid_old")) / F.col("mid_old")).alias("amount_gap"), (F.coalesce("shared", F.lit(0)) / F.greatest(F.lit(1), F.col("people"))).alias("overlap"),
        F.when(cadence_old > 0, F.col("rows_new") / F.greatest(F.lit(1), F.col("months_new")) / cadence_old).otherwise(0.0).alias("cadence_ratio"),
    )
    fit = e.where((F.col("amount_gap") <= GAP) & (F.col("overlap") >= SHARED) & F.col("cadence_ratio").between(*CADENCE))
    fit = fit.groupBy("new_core").agg(F.min_by(F.struct("old_core", "month", "amount_gap", "overlap", "cadence_ratio"), "old_core").alias("x")).select("new_core", "x.*")
    return fit.join(companies.select(F.col("core").alias("old_core"), "company"), "old_core").select("old_core", "new_core", "company", "month", "amount_gap", "overlap", "cadence_ratio")


def map_companies(df: DataFrame, companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds company by core: known names and their successors; '' for spend that is none of theirs."""
    names = companies.select("core", "company")
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("new_core").alias("core"), "company"))
    return df.join(names.dropDuplicates(["core"]), "core", "left").withColumn("company", F.coalesce("company", F.lit("")))


def hard_checks(df: DataFrame, panelists: DataFrame, repaired: DataFrame, doubled: DataFrame, columns: Sequence[str], content: Sequence[str], calendar: tuple[str, str], most: float) -> DataFrame:
    """(check_name, n_violations, passed) of the checks that a feed must pass before anything is estimated."""
    spark = df.sparkSession
    schema = spark.range(1).select(F.lit("schema_columns").alias("check_name"), F.lit(int(df.columns[: len(columns)] != list(columns))).cast("long").alias("n_violations"))
    return quality.report([
        schema, quality.unique(df, ["txn_id"], "txn_id_unique"), quality.unique(repaired.join(doubled, "day", "left_semi"), content, "content_unique_on_doubled_days"),
        quality.violations(df, ~((F.col("amount") > 0) & (F.col("amount") < most)) | F.col("amount").isNull(), "amounts_sane"),
        quality.violations(df, ~F.col("day").between(*calendar) | F.col("day").isNull(), "days_within_calendar"), quality.relationship(df, "panelist", panelists, "panelist", "panelists_known"),
    ])


def enforce(report: DataFrame) -> DataFrame:
    """The report, if all checks passed; else the run ends with the names of those that failed."""
    bad = report.where("not passed").select("check_name", "n_violations").collect()  # a row a check
    if bad:
        raise ValueError("failed checks: " + ", ".join(f"{r['check_name']} ({r['n_violations']})" for r in sorted(bad)))
    return report


def weekly_drift(df: DataFrame, week: str, good: str, drop: float = DRIFT, weeks: int = DRIFT_WEEKS) -> DataFrame:
    """Per week: rows, rate of good ones, mean rate of the weeks before, and whether it fell by drop or more; the first
    weeks have no verdict. One window over the weeks: a calendar."""
    g = df.groupBy(week).agg(F.count("*").alias("n_rows"), (F.count_if(F.col(good)) / F.count("*")).alias("rate"))
    w = W.orderBy(week)
    before = F.when(F.row_number().over(w) > weeks, F.avg("rate").over(w.rowsBetween(-weeks, -1)))
    return g.withColumn("before", before).withColumn("drift", F.coalesce(F.col("rate") <= F.col("before") - drop, F.lit(False)))


def drift_tokens(df: DataFrame, drifted: DataFrame, week: str, text: str, good: str, most: int = 3) -> DataFrame:
    """(week, token, n): what leads the texts that were not good in weeks of drift, the most frequent first tokens."""
    lead = F.regexp_extract(F.upper(F.col(text)), "^[A-Z0-9]+", 0)
    c = df.where(~F.col(good)).join(drifted.where("drift").select(week), week, "left_semi").select(week, lead.alias("token")).where("token <> ''").groupBy(week, "token").agg(F.count("*").alias("n"))
    return c.withColumn("_r", F.row_number().over(W.partitionBy(week).orderBy(F.desc("n"), "token"))).where(F.col("_r") <= most).drop("_r")
