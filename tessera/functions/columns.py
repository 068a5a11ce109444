"""Column builders: tiers, ratios, keys, calendar labels and text rules. Pure expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first threshold that value reaches, highest first; null and lower values get the default."""
    out = None
    for at, label in sorted(steps, reverse=True):
        out = F.when(value >= at, label) if out is None else out.when(value >= at, label)
    return out.otherwise(default)


def band(value: Column, bands: Sequence[tuple[float, str]], missing: str = "no_data") -> Column:
    """Half-open bands: the label of the last lower edge that value reaches; below the first edge the first label."""
    low = sorted(bands)
    return F.when(value.isNull(), missing).otherwise(tier(value, low[1:], low[0][1]))


def safe_ratio(x: Column, y: Column) -> Column:
    """Null where the denominator is zero or null."""
    return x / F.when(y != 0, y)


def guarded_ratio(x: Column, y: Column) -> Column:
    """Zero where the denominator is not positive."""
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def surrogate_key(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def money(name: str) -> Column:
    """An exact sum of amounts in cents, so that the order of rows does not matter."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def fiscal_label(date: Column) -> Column:
    """FY of the year; periods that end before June belong to the year before."""
    return F.concat(F.lit("FY"), (F.year(date) - F.when(F.month(date) < 6, 1).otherwise(0)).cast("string"))


def floor3(x: Column) -> Column:
    return F.floor(x * 1000) / 1000


def log_growth(now: Column, before: Column) -> Column:
    """Null unless both are positive."""
    return F.when((now > 0) & (before > 0), F.log(now) - F.log(before))


#: Scale factors that a unit mix-up produces, and the tolerance of the ratio.
SCALES, SCALE_TOLERANCE = (100.0, 1_000.0, 10_000.0, 1_000_000.0), 0.05


def scale_mixup(low: Column, high: Column) -> Column:
    """Whether two numbers of one sign differ by about a scale factor; zeros never do."""
    ratio = F.greatest(F.abs(low), F.abs(high)) / F.least(F.abs(low), F.abs(high))
    near = None
    for s in SCALES:
        hit = F.abs(ratio / s - 1) <= SCALE_TOLERANCE
        near = hit if near is None else near | hit
    return F.when((low == 0) | (high == 0) | (F.signum(low) != F.signum(high)), F.lit(False)).otherwise(near)


# --- text

#: Fixed patterns: processor prefixes and trailing decorations of merchant strings.
PREFIX = r"^(SQ \*|PAYPAL \*|PP\*|STRIPE\*|FS \*|IN \*|WEB\*)\s*"
JUNK = r"(\s+#?\d{2,}|\s+STORE\s*\d+|\s+\d{3}-\d{3}-\d{4}|\s+\.COM|\s+INC\.?|\s+LLC|\s+RENEWAL|\s+MONTHLY|\s+NYC|\s+AUSTIN TX)+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def merchant(raw: Column) -> Column:
    """Core of a merchant string: no prefix, no trailing decoration (looked for again once punctuation has gone)."""
    x = F.regexp_replace(strip(F.upper(raw)), PREFIX, "")
    x = F.regexp_replace(F.regexp_replace(x, JUNK, ""), r"[^A-Z0-9&. ]", " ")
    x = strip(F.regexp_replace(x, r"\s{2,}", " "))
    return strip(F.regexp_replace(F.regexp_replace(x, JUNK, ""), r"\s{2,}", " "))


def descriptor_core(raw: Column) -> Column:
    """Upper case words without trailing ones that hold a digit; the first word stays."""
    x = strip(F.regexp_replace(F.regexp_replace(F.upper(raw), r"[^A-Z0-9]", " "), r"\s+", " "))
    return F.regexp_replace(x, r"( [A-Z0-9]*[0-9][A-Z0-9]*)+$", "")


def fingerprint(title: Column, place: Column) -> Column:
    x = strip(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9 ]", " "), r"\s+", " "))
    return F.concat_ws("|", x, place)


def tokens(x: Column) -> Column:
    """Lower-case alphanumeric tokens; marks inside a token go, empty tokens go."""
    parts = F.split(F.lower(x), r"[\s\-_]+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"[^a-z0-9]+", "")), lambda t: t != "")


#: Words of company names that no board slug holds.
LEGAL = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "ag", "nv", "group", "holdings", "the", "and")


def slugs(company: Column) -> Column:
    """Likely board slugs of a company, best first, without repeats."""
    every = tokens(company)
    own = F.filter(every, lambda t: ~t.isin(*LEGAL))
    own = F.when(F.size(own) > 0, own).otherwise(every)
    squashed = F.regexp_replace(F.lower(strip(company)), r"[^a-z0-9]", "")
    joined = F.array(F.array_join(own, ""), F.array_join(own, "-"), F.array_join(own, "_"), squashed)
    return F.array_distinct(F.filter(joined, lambda s: s != ""))


#: Words that tell where work is done.
HYBRID = ("hybrid", "flex office", "flexible location")
REMOTE = ("remote", "work from home", "wfh", "fully distributed", "work anywhere", "anywhere")
ONSITE = ("on-site", "on site", "onsite", "in-office", "in office", "in-person", "in person")
ONSITE_FIELD = ("on-site", "on site", "onsite", "office", "in person", "in-person")


def any_of(x: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def workplace(location: Column, extra: Column, explicit: Column) -> Column:
    """Hybrid, remote, onsite or unknown: an explicit field first, then the words of place and text."""
    e = F.lower(strip(F.coalesce(explicit, F.lit(""))))
    blob = F.lower(F.concat_ws(" ", F.when(location != "", location), F.when(extra != "", extra)))
    return (
        F.when(e.contains("hybrid"), "hybrid").when(e.contains("remote"), "remote").when(any_of(e, ONSITE_FIELD), "onsite")
        .when(any_of(blob, HYBRID), "hybrid").when(any_of(blob, REMOTE), "remote").when(any_of(blob, ONSITE), "onsite").otherwise("unknown")
    )


def title_score(query: Column, title: Column) -> Column:
    """Share of the query's tokens (repeats count) that the title has; at least 0.95 if it holds the whole query."""
    q, t = tokens(query), tokens(title)
    share = F.size(F.filter(q, lambda x: F.array_contains(t, x))) / F.size(q)
    whole = F.lower(strip(title)).contains(F.lower(strip(query)))
    return F.when(F.coalesce(F.size(q), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.when(whole, F.greatest(share, F.lit(0.95))).otherwise(share), 3))


#: Rules for the function of a job title; the first that is found decides.
TITLE_RULES = (
    (r"\bsales\b", "sales"), (r"\baccount executive\b", "sales"), (r"\bbusiness development\b", "sales"), (r"\bchannel partner\b", "sales"), (r"\bregional sales\b", "sales"),
    (r"\bcustomer support\b", "support"), (r"\btechnical support\b", "support"), (r"\bsupport team\b", "support"), (r"\bcustomer success\b", "support"), (r"\bhelp desk\b", "support"),
    (r"\bimplementation specialist\b", "support"), (r"\b(ml|machine learning|ai) infrastructure\b", "ml_infrastructure"), (r"\bgpu\b", "ml_infrastructure"), (r"\bcluster\b", "ml_infrastructure"),
    (r"\bmlops\b", "ml_infrastructure"), (r"\bdistributed training\b", "ml_infrastructure"), (r"\binference\b", "ml_infrastructure"), (r"\bdatacenter\b", "ml_infrastructure"),
    (r"\bresearch scientist\b", "research"), (r"\bresearcher\b", "research"), (r"engineer", "engineering"), (r"\bdeveloper\b", "engineering"), (r"\bsoftware\b", "engineering"),
    (r"\bdata engineer\b", "engineering"), (r"\binfrastructure\b", "engineering"),
)


def first_rule(text: Column, rules: Sequence[tuple[str, str]] = TITLE_RULES, default: str = "other") -> Column:
    out = None
    for pattern, label in rules:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


#: Keywords of merchant categories.
CATEGORIES = (
    ("AI and ML Platforms", ("AI", "ML", "GPT", "CLAUDE", "LLM", "NEURAL", "VECTOR", "MODEL")),
    ("Cloud Infrastructure", ("CLOUD", "COMPUTE", "HOST", "SERVER", "GRID", "EDGE", "CDN")),
    ("Data Infrastructure", ("DATA", "DB", "ANALYTIC", "WAREHOUSE", "PIPELINE", "QUERY")),
    ("Developer Tools", ("DEV", "CODE", "GIT", "CI", "BUILD", "SYSTEMS", "LABS")),
    ("Security", ("SEC", "AUTH", "TRUST", "SHIELD", "GUARD")),
    ("Payments and Fintech", ("PAY", "BILL", "FIN", "CARD", "TREASURY")),
    ("SaaS Productivity", ("DOC", "TEAM", "WORK", "MEET", "NOTE")),
)


def category(core: Column) -> Column:
    """The category with most keywords found; of equal ones the last by name; none found: Unclassified."""
    found = [F.struct(sum((F.when(core.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("n"), F.lit(c).alias("c")) for c, words in CATEGORIES]
    best = F.array_max(F.array(*found))
    return F.when(best["n"] > 0, best["c"]).otherwise("Unclassified")


def plain_html(html: Column, limit: int = 400) -> Column:
    """Text without tags, with basic entities decoded and white space collapsed; cut with three dots."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = strip(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit)), F.lit("..."))).otherwise(x)


def blank_default(x: Column, default: str) -> Column:
    """A text without outer blanks, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def calendar(spark, first: str, last: str):
    """A row a month between two dates: month (its first day), mi and qi (months and quarters by the era), label, days,
    month_end, quarter_start, quarter_end, published (the first of the next month)."""
    m = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.trunc(F.lit(last).cast("date"), "MM"), F.expr("interval 1 month"))).alias("month"))
    d = F.col("month")
    end = F.last_day(d)
    return m.select("month", month_index(d).alias("mi"), quarter_index(d).alias("qi"), quarter_label(d).alias("label"), F.dayofmonth(end).alias("days"), end.alias("month_end"), F.trunc(d, "quarter").alias("quarter_start"), F.last_day(F.add_months(F.trunc(d, "quarter"), 2)).alias("quarter_end"), F.add_months(d, 1).alias("published"))
