"""URL filters by a temporal list join.

A list is a log of dated entries (day, kind, value, active); an entry's row holds until the next row of the same kind
and value. Such rows become validity intervals. Every capture is looked up under the keys its URL has (its host with
every parent domain, its words of host and path, its path prefixes) and evaluated against the interval that holds on
the day of its fetch: an as-of join. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: The log of the query: first and later states of domain, word and path rules.
ENTRIES = (
    ("2024-01-01", "domain", "casino-win.example.com", True),
    ("2024-02-01", "domain", "free-bets.example.com", True),
    ("2024-04-01", "domain", "free-bets.example.com", False),
    ("2024-07-01", "domain", "free-bets.example.com", True),
    ("2024-03-10", "domain", "example.net", True),
    ("2024-03-20", "domain", "example.net", False),
    ("2024-05-15", "word", "casino", True),
    ("2024-06-01", "word", "adult", True),
    ("2024-06-01", "word", "bets", True),
    ("2024-09-01", "word", "bets", False),
    ("2024-08-01", "path", "example.org/en/1", True),
    ("2024-10-01", "path", "example.org/de", True),
)
#: A hot host or word is spread over this many shares of the captures; the list is repeated for each.
SHARES = 16


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, since, until (exclusive; null: still valid) of the active spans of a log of (day, kind, value, active).

    Of several rows for one day the one that sets active wins. Rows with a null day, kind, value or state are ignored.
    """
    log = entries.where("day is not null and kind is not null and value is not null and active is not null")
    log = log.groupBy("kind", "value", "day").agg(F.max("active").alias("active"))
    w = W.partitionBy("kind", "value").orderBy("day")
    return log.select("kind", "value", F.col("day").alias("since"), F.lead("day").over(w).alias("until"), "active").where("active").drop("active")


def host(url: Column) -> Column:
    """Lower case, without user, port and closing dot; empty for a URL with no host."""
    authority = F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\\\s]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path(url: Column) -> Column:
    """The path without query and fragment, lower case, starting with /."""
    return F.lower(F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//[^/?#\\\s]*(/[^?#\s]*)?", 1))


def keys(labels: int, steps: int) -> Column:
    """All (kind, value) under which a list could hold a URL, of the columns _host and _path.

    labels and steps: the most host labels and path steps that any entry has. Longer values match no entry, so a URL has
    at most labels domains and labels * steps paths, however long it is.
    """
    none = F.array().cast("array<string>")
    own = F.split("_host", r"\.")
    some = F.sequence(F.lit(1), F.least(F.size(own), F.lit(max(1, labels))))
    parents = F.when((F.col("_host") != "") & F.lit(labels > 0), F.transform(some, lambda n: F.concat_ws(".", F.slice(own, -n, n)))).otherwise(none)
    text = F.array_distinct(F.filter(F.split(F.concat("_host", "_path"), r"[^a-z0-9]+"), lambda x: x != ""))
    of = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    found = [of("domain", parents), of("word", text)]
    if steps > 0:
        deep = F.slice(F.filter(F.split("_path", "/"), lambda x: x != ""), 1, steps)
        begins = F.when(F.size(deep) > 0, F.transform(F.sequence(F.lit(1), F.size(deep)), lambda n: F.concat_ws("/", F.slice(deep, F.lit(1), n)))).otherwise(none)
        found.append(of("path", F.flatten(F.transform(begins, lambda x: F.transform(parents, lambda p: F.concat_ws("/", p, x))))))
    return F.concat(*found)


def extent(entries: DataFrame) -> tuple[int, int]:
    """The most host labels and path steps of the entries: two numbers, whatever the list's length."""
    host_of = F.substring_index("value", "/", 1)
    labels = F.when(F.col("kind").isin("domain", "path"), F.size(F.split(host_of, r"\.")))
    steps = F.when(F.col("kind") == "path", F.size(F.split("value", "/")) - 1)
    r = entries.agg(F.max(labels), F.max(steps)).first()
    return r[0] or 0, r[1] or 0


def evaluate(captures: DataFrame, entries: DataFrame, shares: int = SHARES) -> DataFrame:
    """One row per capture (page_id, url, fetched): its host, whether it is blocked, by how many entries and by which first.

    captures is a frame of page_id, url, fetched (date); repeated rows are evaluated each. A null or host-less URL has
    no keys and passes; a null fetch date passes, for no interval is known to hold. An empty list blocks nothing.
    first_kind and first_value: of the smallest (kind, value) that holds; n_rules: how many hold.
    The list and the captures are joined by (kind, value, share), so that a host with a third of all captures is
    spread over many tasks; captures without any listed key are never shuffled by it twice.
    """
    c = captures.select("page_id", "url", "fetched").withColumns({"_host": host(F.coalesce("url", F.lit(""))), "_path": path(F.coalesce("url", F.lit("")))})
    c = c.withColumn("_share", F.pmod(F.xxhash64("page_id", "url"), F.lit(shares)))
    distinct = c.select("url", "_host", "_path", "fetched", "_share").distinct()
    lists = intervals(entries).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    exploded = distinct.where("fetched is not null").select("url", "fetched", "_share", F.explode(keys(*extent(entries))).alias("k")).select("url", "fetched", "_share", "k.kind", "k.value")
    holds = exploded.join(lists, ["kind", "value", "_share"]).where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    found = holds.groupBy("url", "fetched", "_share").agg(F.count("*").alias("n"), F.min(F.struct("kind", "value")).alias("first"))
    same = F.col("c.url").eqNullSafe(F.col("f.url")) & F.col("c.fetched").eqNullSafe(F.col("f.fetched")) & (F.col("c._share") == F.col("f._share"))
    return c.alias("c").join(found.alias("f"), same, "left").select(
        "page_id", "c.url", "c.fetched", F.col("_host").alias("host"), F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_rules"), F.col("first.kind").alias("first_kind"), F.col("first.value").alias("first_value"),
    )


def log(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], "day date, kind string, value string, active boolean")
    each = [F.struct(F.lit(d).cast("date").alias("day"), F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(a).alias("active")) for d, k, v, a in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the log; a page was fetched on the day of 2024 that its id gives, in turn (a null id: never). Other
    cases as in evaluate()."""
    pages = common.table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    out = evaluate(pages.select("page_id", "url", day.alias("fetched")), log(spark))
    return out.select("page_id", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host", "blocked", "n_rules", "first_kind", "first_value")


_VALUES = ", ".join(f"(DATE '{d}', '{k}', '{v}', {str(a).lower()})" for d, k, v, a in ENTRIES)
SQL = rf"""
WITH log(day, kind, value, active) AS (VALUES {_VALUES}),
spans AS (SELECT * FROM (SELECT kind, value, active, day AS since, lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS until FROM log) WHERE active),
c AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\\s]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#\\\s]*(/[^?#\s]*)?', 1)) AS path
  FROM pages),
hits AS (
  SELECT c.page_id, s.kind, s.value FROM c JOIN spans s
  ON c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until)
  AND CASE s.kind WHEN 'domain' THEN c.host = s.value OR ends_with(c.host, '.' || s.value)
      WHEN 'word' THEN list_contains(regexp_split_to_array(c.host || c.path, '[^a-z0-9]+'), s.value)
      ELSE (ends_with('.' || c.host, '.' || split_part(s.value, '/', 1)))
           AND starts_with(regexp_replace(c.path, '/+', '/', 'g') || '/', substr(s.value, length(split_part(s.value, '/', 1)) + 1) || '/') END),
best AS (SELECT page_id, count(*) AS n, min(struct_pack(kind := kind, value := value)) AS f FROM hits GROUP BY page_id)
SELECT c.page_id, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, best.n IS NOT NULL AS blocked, coalesce(best.n, 0)::BIGINT AS n_rules,
       best.f.kind AS first_kind, best.f.value AS first_value
FROM c LEFT JOIN best USING (page_id)
"""
