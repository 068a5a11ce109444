"""Job postings of four platforms to one shape: title, location, workplace, department, url, posted_at, source, job_id.

Payloads come as rows (platform, token, payload); a payload is the JSON text of a board's list. Live calls are left to
whatever fills that table, so that a run can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boards import verdict
from ..functions.columns import plain_html, title_score, workplace

_GREENHOUSE = "jobs array<struct<id: string, title: string, location: struct<name: string>, departments: array<struct<name: string>>, absolute_url: string, updated_at: string>>"
_LEVER = "array<struct<id: string, text: string, categories: struct<location: string, department: string, team: string>, workplaceType: string, hostedUrl: string, applyUrl: string, createdAt: string, descriptionPlain: string, description: string>>"
_ASHBY = "jobs array<struct<id: string, title: string, location: string, isRemote: boolean, department: string, team: string, jobUrl: string, applyUrl: string, publishedAt: string, descriptionPlain: string>>"
_SMART = "content array<struct<id: string, name: string, location: struct<city: string, region: string, country: string, remote: boolean>, department: struct<label: string>, ref: string, releasedDate: string>>"


def either(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def epoch_day(ms: Column) -> Column:
    """ISO date of epoch milliseconds; null for what is no number."""
    return F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd")


def _shape(x: DataFrame, source: str, title: Column, location: Column, explicit: Column, department: Column, url: Column, posted: Column, text: Column) -> DataFrame:
    none = F.lit("")
    return x.select("token", F.coalesce(title, none).alias("title"), location.alias("location"), workplace(F.coalesce(location, none), none, F.coalesce(explicit, none)).alias("workplace"), department.alias("department"),
                    url.alias("url"), posted.alias("posted_at"), F.lit(source).alias("source"), F.col("j.id").alias("job_id"), plain_html(text).alias("excerpt"))


def greenhouse(p: DataFrame) -> DataFrame:
    x = p.select("token", F.explode(F.from_json("payload", _GREENHOUSE)["jobs"]).alias("j"))
    null = F.lit(None).cast("string")
    return _shape(x, "greenhouse", F.col("j.title"), F.col("j.location.name"), null, F.get(F.col("j.departments"), F.lit(0))["name"], F.col("j.absolute_url"), F.col("j.updated_at"), null)


def lever(p: DataFrame) -> DataFrame:
    x = p.select("token", F.explode(F.from_json("payload", _LEVER)).alias("j"))
    return _shape(x, "lever", F.col("j.text"), F.col("j.categories.location"), F.col("j.workplaceType"), either("j.categories.department", "j.categories.team"), either("j.hostedUrl", "j.applyUrl"), epoch_day(F.col("j.createdAt")), either("j.descriptionPlain", "j.description"))


def ashby(p: DataFrame) -> DataFrame:
    x = p.select("token", F.explode(F.from_json("payload", _ASHBY)["jobs"]).alias("j"))
    return _shape(x, "ashby", F.col("j.title"), F.col("j.location"), F.when(F.col("j.isRemote"), "remote"), either("j.department", "j.team"), either("j.jobUrl", "j.applyUrl"), F.col("j.publishedAt"), F.col("j.descriptionPlain"))


def smartrecruiters(p: DataFrame) -> DataFrame:
    x = p.select("token", F.explode(F.from_json("payload", _SMART)["content"]).alias("j"))
    remote = F.when(F.col("j.location.remote"), "remote")
    place = F.concat_ws(", ", either("j.location.city"), either("j.location.region"), either("j.location.country"))
    place = F.coalesce(F.nullif(place, F.lit("")), F.when(F.col("j.location.remote"), "Remote"))
    url = F.coalesce(F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), either("j.id")), F.col("j.ref"))
    return _shape(x, "smartrecruiters", F.col("j.name"), place, remote, F.col("j.department.label"), url, F.col("j.releasedDate"), F.lit(None).cast("string"))


#: Readers by platform; another platform is another entry.
READERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters}


def postings(payloads: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [read(payloads.where(F.col("platform") == name)) for name, read in READERS.items()])


def matching(df: DataFrame, title: str = "", location: str = "", limit: int | None = None) -> DataFrame:
    """Postings whose title and location hold the given texts, in any case; a limit comes after the filters."""
    hit = df.where(F.lower(F.coalesce("title", F.lit(""))).contains(title.lower()) & F.lower(F.coalesce("location", F.lit(""))).contains(location.lower()))
    return hit.orderBy("source", "token", "job_id").limit(limit) if limit is not None else hit


def best_title(df: DataFrame, query: str, least: float = 0.5) -> DataFrame:
    """The posting of each board whose title matches a query best, if its score is high enough; the first wins a tie."""
    scored = df.withColumn("score", title_score(F.lit(query), F.col("title"))).where(F.col("score") >= least)
    best = scored.groupBy("source", "token").agg(F.min_by(F.struct("title", "url", "job_id", "workplace", "score"), F.struct(-F.col("score"), "job_id")).alias("b"))
    return best.select("source", "token", "b.*")


def verified(roles: DataFrame, boards: DataFrame, least: float = 0.5) -> DataFrame:
    """(company, title, matched_title, found, verdict, workplace, location, source, url, confidence) of each role.

    roles: company, title; boards: company, platform, token, payload. The best match of a title on its company's board
    decides; without one the verdict is not-found, without a board unresolved, and one that does not say where work is
    done is ambiguous. Ties go to the first posting by its id.
    """
    own = boards.select("company", "platform", "token")
    p = postings(boards.select("platform", "token", "payload"))
    asked = roles.select("company", F.col("title").alias("asked")).distinct().join(own, "company", "left")
    s = asked.join(p, (F.col("source") == F.col("platform")) & (asked["token"] == p["token"])).withColumn("score", title_score(F.col("asked"), F.col("title"))).where(F.col("score") >= least)
    best = s.groupBy("company", "asked").agg(F.min_by(F.struct("title", "workplace", "location", "source", "url", "score"), F.struct(-F.col("score"), "job_id")).alias("b"))
    j = asked.join(best, ["company", "asked"], "left")
    said = F.when(F.col("platform").isNull(), "unresolved").when(F.col("b").isNull(), "not-found").otherwise(verdict(F.col("b.workplace")))
    return j.select(
        "company", F.col("asked").alias("title"), F.col("b.title").alias("matched_title"), F.col("b").isNotNull().alias("found"), said.alias("verdict"), F.coalesce("b.workplace", F.lit("unknown")).alias("workplace"),
        F.col("b.location").alias("location"), F.coalesce("b.source", "platform").alias("source"), F.col("b.url").alias("url"), F.coalesce("b.score", F.lit(0.0)).alias("confidence"),
    )
