"""Staged resolution of noisy names to known ones: exact, contained, fuzzy within blocks, review, unmatched."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..durable import durable
from ..functions import columns as C

#: Thresholds of the stages.
AUTO, REVIEW, TAIL = 0.90, 0.78, 0.60
#: Letters that may stand between the two of a gram, on both sides together.
GAP = 2
#: Pairs of a name without a likely alias that are compared first, one of each share of the aliases: their best rules out most others.
FIRST = 8


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def rest_of_score(core, alias):
    """The parts of a score that need no comparison of characters: share of the alias's tokens, and a prefix bonus."""
    words = F.array_distinct(F.split(alias, " "))
    overlap = F.size(F.array_intersect(F.split(core, " "), words)) / F.greatest(F.lit(1), F.size(words))
    head = F.expr("substring(alias, 1, greatest(4, cast(length(alias) / 2 as int)))")
    return 0.35 * overlap + F.when(core.startswith(head), 0.15).otherwise(0.0)


def most_alike(a, b):
    """What a ratio can be at most, by lengths."""
    la, lb = F.length(a), F.length(b)
    return 2 * F.least(la, lb) / F.greatest(F.lit(1), la + lb)


def best_pairs(pairs: DataFrame, weight: float, rest: Column, ties: list[Column]) -> DataFrame:
    """The best pair of each core by min(1, weight * similarity + rest), as column s. Characters are compared only in pairs
    that could still be the best: whose bound is not below what another pair of the core has for sure."""
    x = pairs.withColumn("_rest", rest).withColumn("_most", F.least(F.lit(1.0), F.col("_rest") + weight * most_alike(F.col("core"), F.col("alias"))))
    sure = x.groupBy("core").agg(F.max("_rest").alias("_sure"))
    x = x.join(sure, "core").where(F.col("_most") >= F.least(F.lit(1.0), F.col("_sure"))).drop("_sure", "_most")
    x = x.withColumn("s", F.least(F.lit(1.0), weight * similarity("core", "alias") + F.col("_rest"))).drop("_rest")
    others = [c for c in x.columns if c not in ("core", "s")]
    return x.groupBy("core").agg(F.min_by(F.struct("s", *others), F.struct(-F.col("s"), *ties)).alias("x")).select("core", "x.*")


def least_shared(total, threshold: float, gap: int = GAP):
    """(matched, grams) that two strings of total letters share at least if their ratio reaches a threshold; of Columns or
    numbers.

    The ratio is 2 M / total for M matched letters, in order on both sides. Of the M - 1 steps from one matched letter to the
    next, those that skip more than gap letters use up gap + 1 of the total - 2 M unmatched ones each; every other step is a
    gram, two letters with at most gap between them on both sides together.
    """
    up, down = (F.ceil, F.floor) if isinstance(total, Column) else (math.ceil, math.floor)
    matched = up(total * threshold / 2 - 1e-9)
    return matched, matched - 1 - down((total - 2 * matched) / (gap + 1))


def _grams(df: DataFrame, text: str, gap: int) -> DataFrame:
    """df with a row for each two letters (gram) with d letters between them, from place i on."""
    n = F.length(text)
    pair = lambda i, d: F.struct(F.concat(F.substring(text, i, 1), F.substring(text, i + 1 + d, 1)).alias("gram"), i.alias("i"), d.alias("d"))
    of = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(gap)), lambda d: F.when(n > d + 1, F.transform(F.sequence(F.lit(1), n - 1 - d), lambda i: pair(i, d))).otherwise(F.array().cast("array<struct<gram:string,i:int,d:int>>"))))
    return df.select("*", F.inline(of))


def _letters(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each letter and how often it came before (0, 1, ...): equal rows of two strings are the letters that
    they share at most."""
    each = df.select("*", F.explode(F.split(text, "")).alias("letter")).where("letter <> ''").groupBy(*df.columns, "letter").agg(F.count("*").cast("int").alias("_n"))
    return each.select("*", F.explode(F.sequence(F.lit(1), "_n")).alias("nth")).drop("_n")


def _by_letters(cores: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(core, alias, shared) of all pairs with a letter in common: how many letters they share whatever their order. With most,
    only pairs of at most so many letters together."""
    c, a = cores.select("core"), names.select("alias")
    if most is not None:
        c, a = c.where(F.length("core") < most), a.where(F.length("alias") < most)
    c, a = _letters(c, "core"), _letters(a, "alias")
    both = c.join(a, ["letter", "nth"])
    if most is not None:
        both = both.where(F.length("core") + F.length("alias") <= most)
    return both.groupBy("core", "alias").agg(F.count("*").alias("shared"))


def similar(cores: DataFrame, names: DataFrame, threshold: float, gap: int = GAP) -> DataFrame:
    """(core, alias, s) of all pairs of (core) and (alias) whose ratio reaches a threshold, s being the ratio. Both distinct.

    An inverted index of grams: pairs meet at grams that they share, near enough in place for so many letters to match, and
    only those that share as many as the threshold asks for are compared letter by letter. Strings too short for a gram
    meet at letters.
    """
    short = max((n for n in range(2, 400) if least_shared(n, threshold, gap)[1] <= 0), default=0)
    if short == 399:
        raise ValueError("at this threshold two names need not share a gram")
    total = F.length("core") + F.length("alias")
    matched, grams = least_shared(total, threshold, gap)
    c = _grams(cores.select("core"), "core", gap).withColumnsRenamed({"i": "ci", "d": "cd"})
    a = _grams(names.select("alias"), "alias", gap)
    near = (F.col("cd") + F.col("d") <= gap) & (F.col("ci") - F.col("i") <= F.length("core") - matched) & (F.col("i") - F.col("ci") <= F.length("alias") - matched)
    met = c.join(a, "gram").where(near & (F.least(F.length("core"), F.length("alias")) >= matched))
    enough = met.groupBy("core", "alias").agg(F.count_distinct("ci").alias("_n")).where(F.col("_n") >= grams).select("core", "alias")
    if short:
        enough = enough.unionByName(_by_letters(cores, names, short).where(F.col("shared") >= matched).select("core", "alias")).distinct()
    return enough.withColumn("s", similarity("core", "alias")).where(F.col("s") >= threshold)


def nearest(cores: DataFrame, names: DataFrame, threshold: float = TAIL) -> DataFrame:
    """Each core with the alias of the highest ratio, s, and the alias's other columns; ties go to the smaller vendor, then alias.

    cores (core) are distinct and not empty; names: vendor, alias and more, any number of them. Names at or above the threshold
    are found by similar(). What is left resembles nothing: such a core is counted against every alias by letters, the pairs that could be best are
    compared first, and their result rules out those that share too few letters. No pairs are listed but by shared grams or letters.
    """
    aliases = names.select("alias").distinct()
    cores = durable(cores.select("core"))
    found = durable(similar(cores, aliases, threshold))
    left = cores.join(found.select("core").distinct(), "core", "left_anti")
    met = _by_letters(left, aliases).withColumn("_most", 2 * F.col("shared") / (F.length("core") + F.length("alias")))
    met = durable(met.select("core", "alias", "_most"))
    first = met.groupBy("core", F.pmod(F.xxhash64("alias"), F.lit(FIRST))).agg(F.max_by("alias", F.struct("_most", "alias")).alias("alias"))
    sure = first.withColumn("s", similarity("core", "alias")).groupBy("core").agg(F.max("s").alias("_sure"))
    rest = met.join(sure, "core").where(F.col("_most") >= F.col("_sure")).select("core", "alias").withColumn("s", similarity("core", "alias"))
    none = left.join(rest.select("core").distinct(), "core", "left_anti")  # no letter in common with any alias: all ratios are 0
    first = names.agg(F.min(F.struct("vendor", "alias")).alias("x")).select("x.alias").first()  # one row
    zero = none.where(F.lit(first["alias"] is not None)).select("core", F.lit(first["alias"]).cast("string").alias("alias"), F.lit(0.0).alias("s"))
    best = found.unionByName(rest).unionByName(zero)
    top = best.groupBy("core").agg(F.max("s").alias("s"))
    best = best.join(top, ["core", "s"]).join(names, "alias")
    others = [c for c in names.columns if c not in ("vendor", "alias")]
    return best.groupBy("core").agg(F.min(F.struct("vendor", "alias", "s", *others)).alias("x")).select("core", "x.*")


def spans(text):
    """Words between non-alphanumerics, with a blank before and after each."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9]", " "), " +", " "))


def contained(cores: DataFrame, aliases: DataFrame) -> DataFrame:
    """(core, alias, vendor): aliases of three characters or more that stand in a core between non-alphanumerics. Every run
    of a core's words, as long as the longest alias, is looked up; no pair is listed that does not match."""
    a = aliases.where(F.length("alias") >= 3).select("alias", "vendor", spans(F.col("alias")).alias("_k")).where("_k <> ''").withColumn("_n", F.size(F.split("_k", " ")))
    most = a.agg(F.max("_n")).first()[0] or 0  # one number
    if not most:
        return cores.limit(0).select("core", F.lit("").alias("alias"), F.lit("").alias("vendor"))
    w = F.split(spans(F.col("core")), " ")
    runs = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))))
    return cores.select("core", runs.alias("_k")).join(a, "_k").select("core", "alias", "vendor")


def blocks(text):
    return F.array_distinct(F.transform(F.split(text, " "), lambda t: F.substring(t, 1, 3)))


def resolve(raw: DataFrame, vendors: DataFrame) -> DataFrame:
    """(core) of distinct raw cores against (vendor, alias): core, method, score, vendor.

    Cores are resolved once each, whatever their number of rows. Of aliases that a core contains the longest wins, whatever
    block it shares. Candidates of the rest share a block, the first three characters of a token; a core without any goes
    to the nearest of all aliases, of which there may be any number.
    """
    cores = raw.select("core").where("core <> ''").distinct()
    aliases = vendors.groupBy("alias").agg(F.min("vendor").alias("vendor"))
    exact = cores.join(aliases, cores["core"] == aliases["alias"]).select("core", F.lit("exact").alias("method"), F.lit(1.0).alias("score"), "vendor")
    left = cores.join(exact, "core", "left_anti")
    held = contained(left, aliases).groupBy("core").agg(F.max_by("vendor", F.struct(F.length("alias"), "alias")).alias("vendor"))
    held = held.select("core", F.lit("exact").alias("method"), F.lit(0.98).alias("score"), "vendor")
    left = left.join(held, "core", "left_anti")
    keyed = aliases.select("vendor", "alias", F.explode(F.array_union(blocks(F.col("alias")), F.array(F.substring("alias", 1, 3)))).alias("block"))
    pairs = left.select("core", F.explode(blocks(F.col("core"))).alias("block")).join(keyed, "block").select("core", "vendor", "alias").distinct()
    best = best_pairs(pairs, 0.55, rest_of_score(F.col("core"), F.col("alias")), [F.col("vendor"), F.col("alias")]).select("core", "s", "vendor")
    alone = left.join(pairs.select("core").distinct(), "core", "left_anti")  # shares no token or beginning either: the ratio is all
    best = best.unionByName(nearest(alone, aliases.select("vendor", "alias")).select("core", (0.55 * F.col("s")).alias("s"), "vendor"))
    method = F.when(F.col("s") >= AUTO, "fuzzy_auto").when(F.col("s") >= REVIEW, "review").otherwise("unmatched")
    fuzzy = best.select("core", method.alias("method"), C.floor3(F.col("s")).alias("score"), F.when(F.col("s") >= REVIEW, F.col("vendor")).alias("vendor"))
    return exact.unionByName(held).unionByName(fuzzy)


def greedy_match(events: DataFrame, flags: DataFrame, by: list[str], k: int) -> DataFrame:
    """One-to-one matches of events to flags of one key within k periods: events in order, nearest unused flag, earlier on ties."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        free = sorted(set(right["period"]))
        rows = []
        for p in sorted(left["period"]):
            near = sorted((abs(f - p), f) for f in free if f not in used and abs(f - p) <= k)
            hit = near[0][1] if near else None
            used |= {hit} if near else set()
            rows.append((*key, p, hit))
        return pd.DataFrame(rows, columns=[*by, "event_period", "flag_period"]).astype({"flag_period": "Int64"})

    kinds = dict(events.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", event_period long, flag_period long"
    right = flags.select(*by, "period").toDF(*[f"{b}_" for b in by], "period")  # own names: both sides may come of one frame
    return events.select(*by, "period").groupBy(*by).cogroup(right.groupBy(*[f"{b}_" for b in by])).applyInPandas(run, schema)


def tag_tail(cores: DataFrame, vendors: DataFrame) -> DataFrame:
    """(core, vendor_guess, category_guess, confidence, new_vendor_flag) of distinct cores against (vendor, alias, category).

    The nearest of all aliases, of which there may be any number, is the guess. Below the threshold a core is a new vendor
    of a category guessed from its words.
    """
    own = cores.select("core").where("core <> ''").distinct()
    best = nearest(own, vendors.select("vendor", "alias", "category")).select("core", F.struct("s", "vendor", "category").alias("b"))
    known = F.col("b.s") >= TAIL
    return best.select("core", F.when(known, F.col("b.vendor")).otherwise("").alias("vendor_guess"), F.when(known, F.col("b.category")).otherwise(C.category(F.col("core"))).alias("category_guess"),
                       F.round("b.s", 3).alias("confidence"), (~known).cast("int").alias("new_vendor_flag"))


def covered_once(sent: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Keys that a tagger left out or returned more than once; empty for a complete answer."""
    n = tags.groupBy(key).agg(F.count("*").alias("n_returned"))
    return sent.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n_returned", F.lit(0)).alias("n_returned")).where("n_returned <> 1")


def merge_tags(resolved: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds final_vendor, final_method and new_vendor_flag: settled rows stay, the tail follows the tagger, a candidate
    under review outlives a tagger that abstains, and a row that the tagger dropped says so."""
    j = resolved.join(tags.select("core", "vendor_guess", F.col("new_vendor_flag").alias("_new"), F.lit(True).alias("_tagged")), "core", "left")
    tail, review = F.col("method").isin("review", "unmatched"), F.col("method") == "review"
    guessed = F.col("vendor_guess") != ""
    method = (
        F.when(~tail, F.col("method")).when(F.col("_tagged").isNull(), "tagger_dropped").when(guessed & review, "tagger_review").when(guessed, "tagger_tail")
        .when(review, "review_unconfirmed").otherwise("new_vendor_candidate")
    )
    j = j.withColumn("final_method", method)
    vendor = F.when(F.col("final_method").isin("tagger_review", "tagger_tail"), F.col("vendor_guess")).when(F.col("final_method").isin("tagger_dropped", "new_vendor_candidate"), "").otherwise(F.col("vendor"))
    flag = F.when(F.col("final_method").isin("tagger_review", "tagger_tail", "new_vendor_candidate"), F.col("_new")).otherwise(0)
    return j.withColumn("final_vendor", vendor).withColumn("new_vendor_flag", flag).drop("vendor_guess", "_new", "_tagged")


def method_precision(df: DataFrame, method: str, assigned: str, truth: str) -> DataFrame:
    """Per method: assigned rows, right ones, precision, and rows whose truth is null (no known vendor) but that got one."""
    got = df.where(F.coalesce(F.col(assigned).cast("string"), F.lit("")) != "")
    right = F.coalesce(F.col(assigned) == F.col(truth), F.lit(False))
    g = got.groupBy(method).agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.count_if(F.col(truth).isNull()).alias("n_false_merges"))
    return g.withColumn("precision", F.col("n_correct") / F.col("n"))
