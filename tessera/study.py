"""A whole panel study: make a world, check and repair its feed, estimate by four methods, score them, write reports."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import estimators, feeds, quality
from .sources import files
from .sources import panelworld as world

CONTENT = ["panelist", "day", "descriptor", "amount", "instrument"]
COLUMNS = ["txn_id", "panelist", "day", "descriptor", "amount", "instrument"]


def steps(s: SparkSession, w: world.World, folder: str, replicates: int | None = 400, watched: float = feeds.WATCHED, monthly: float = feeds.MONTHLY) -> dict[str, DataFrame]:
    """All frames of a study by name. Ends with an error if a hard check fails.

    Tables that later steps share are written to folder, which all executors must see, and read again.
    """
    keep = lambda name, df: files.settled(df, f"{folder}/{name}")
    people = keep("people", world.population(s, w))
    panel = keep("panel", world.recruit(people, w))
    subs, bought = keep("subscriptions", world.subscriptions(people, w)), keep("purchases", world.purchases(people, w))
    raw = keep("raw", world.feed(people, panel, subs, bought, w))
    doubled = keep("doubled", feeds.doubled_days(raw, CONTENT, "day"))
    bad = doubled.where("doubled").select("day")
    cored = lambda x: x.withColumn("core", C.descriptor_core(F.col("descriptor"))).withColumn("month", world.month_of(F.col("day")))
    once = keep("once", cored(quality.dedupe_where(raw, bad, "day", CONTENT, "txn_id")))
    last = f"{2021 + w.months // 12}-12-31"
    checks = feeds.enforce(feeds.hard_checks(raw, panel, once, bad, COLUMNS, CONTENT, ("2022-01-01", last), 10_000.0))
    names = world.companies(s)
    found = keep("renamed", feeds.renamed(once, names, w.months, monthly))
    every = names.unionByName(found.join(names.select("company", "subscription"), "company").select("company", F.col("new_core").alias("core"), "subscription"))
    silent = keep("outages", feeds.outages(once, "instrument", "day", watched=watched))
    facts = keep("truth", world.truth(subs, bought, w))
    cell = panel.select((F.col("age") * 3 + F.col("income")).alias("cell"), "joined", "left")
    p = world.study(panel, cored(raw), once, every, world.census(people), world.reported(facts, 1e5 * w.people / 200_000, 1e3 * w.people / 200_000), silent, w)
    intervals = estimators.bootstrap(p, replicates) if replicates else None
    table = keep("estimates", estimators.estimate_table(p, 4, intervals))
    long = facts.select("company", "quarter", "revenue", F.col("actives").cast("double").alias("actives"), F.col("gross_adds").cast("double").alias("gross_adds"), "churn_rate", "arpu", "market_share").unpivot(["company", "quarter"], list(estimators.KPIS), "kpi", "truth")
    return {
        "checks": checks, "doubled_days": doubled.where("doubled"), "waves": feeds.recruitment_waves(cell, w.months).where("wave"), "outages": silent, "renamed": found,
        "truth": facts, "estimates": table, "scorecard": estimators.scorecard(table, long),
    }


ORDER = {"checks": ["check_name"], "doubled_days": ["day"], "waves": ["month"], "outages": ["first"], "renamed": ["new_core"], "truth": ["company", "quarter"], "estimates": ["method", "company", "quarter", "kpi"], "scorecard": ["kpi", "method"]}


def write(frames: dict[str, DataFrame], folder: str) -> None:
    """Every frame as CSV in a fixed order of rows and columns."""
    for name, by in ORDER.items():
        files.write_csv(frames[name].orderBy(*by), f"{folder}/{name}", frames[name].columns)


def main(arguments: list[str]) -> int:
    from .session import local_session

    s = local_session()
    try:
        frames = steps(s, world.World(people=int(arguments[1]) if len(arguments) > 1 else 20_000, panel=2000, wave=(16, 500)), f"{arguments[0]}/tables", None, 5, 10)
        write(frames, arguments[0])
        print(files.render(frames["scorecard"].orderBy("kpi", "method")))
        return 0
    except ValueError as e:  # a hard check
        print(e, file=sys.stderr)
        return 1
    finally:
        s.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
