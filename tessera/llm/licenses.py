"""License scans by diagonal voting.

All rolling word k-grams of the documents are hashed and joined to the positions at which templates hold them. A document
word at p that stands at q in a template votes for the diagonal p - q. Votes are aggregated by diagonal, neighbouring
diagonals (a few words inserted or left out) merge into one span, and a span is verified: its grams equal the template's
word by word, they cover enough of the template, and the span is not much longer than the template.

All of it is DataFrame code. Only grams that hit a template are ever shuffled; texts never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Words are runs of digits, letters a to z and all that is not ASCII, after A-Z are lowered; these characters part them.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a gram has; a template with fewer is one gram.
K = 3
#: Share of a template's words that the grams of a span cover.
COVER = 0.8
#: Neighbouring diagonals are at most one word in so many of the template apart; short templates allow no shift.
DRIFT = 8
#: A span has at most so many times the template's words.
STRETCH = 2
#: Catalogues of up to so many template grams are broadcast; a larger one is joined by a shuffle.
BROADCAST = 1_000_000

#: (label, phrase): fixed values. Each place where all words stand consecutively counts.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: (label, template): fixed values, the customary wording of common license notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; none for a null or empty text."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), APART), "")


def catalogue(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template (a number), label, phrase (it counts by places), text."""
    each = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in templates]
    if not each:
        return spark.createDataFrame([], "template int, label string, phrase boolean, text string")
    rows = [F.struct(F.lit(n).alias("template"), F.lit(x).alias("label"), F.lit(p).alias("phrase"), F.lit(t).alias("text")) for n, (x, p, t) in enumerate(each)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def grams(df: DataFrame, lengths: Sequence[int], *keep: str) -> DataFrame:
    """A row for each position of the array column words and each gram length that fits there: keep, at (from 0), k, gram
    (a hash), and the words w1, w2, ... from there on, at least k of them."""
    most = max(lengths, default=1)
    zipped = df.select(*keep, F.arrays_zip(*(F.slice("words", i, F.size("words")) for i in range(1, most + 1))).alias("_z"))
    # outer: else Spark filters by the size of what it explodes, and so makes it several times
    each = zipped.select(*keep, F.posexplode_outer("_z").alias("at", "_g")).select(*keep, "at", *(F.col(f"_g.{i}").alias(f"w{i + 1}") for i in range(most)))
    made = []
    for k in lengths:
        own = [F.col(f"w{i}") for i in range(1, k + 1)]
        made.append(F.struct(F.lit(k).alias("k"), F.when(own[-1].isNotNull(), F.xxhash64(F.lit(k), *own)).alias("gram")))
    return each.select("*", F.inline(F.array(*made))).where("gram is not null")


def diagonals(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """did, key, template, label, phrase, n (words of the template), k, diagonal, votes (template positions, distinct), of documents
    (did, key, text)."""
    t = templates.select("template", "label", "phrase", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    t = t.withColumn("_k", F.least("n", F.lit(k)))
    lengths = sorted(r[0] for r in t.select("_k").distinct().collect()) or [1]  # k numbers at most
    ws = [f"w{i}" for i in range(1, max(lengths, default=1) + 1)]
    own = grams(docs.select("did", "key", words(F.col("text")).alias("words")), lengths, "did", "key")
    held = grams(t, lengths, "template", "label", "phrase", "n", "_k").where("k = _k")
    size = held.count()
    held = held.groupBy("gram").agg(F.collect_list(F.struct("template", "label", "phrase", "n", F.col("k").alias("tk"), F.col("at").alias("q"), *(F.col(w).alias(f"t{w}") for w in ws))).alias("_held"))
    hits = own.join(F.broadcast(held) if size <= BROADCAST else held, "gram").select("did", "key", "at", "k", *ws, F.inline("_held"))
    same = F.col("k") == F.col("tk")
    for i, w in enumerate(ws):  # equal words, not only equal hashes
        same &= (F.col("k") <= i) | F.col(w).eqNullSafe(F.col(f"t{w}"))
    hits = hits.where(same).select("did", "key", "template", "label", "phrase", "n", "k", "q", (F.col("at") - F.col("q")).alias("diagonal"))
    return hits.groupBy("did", "key", "template", "label", "phrase", "n", "k", "diagonal").agg(F.collect_set("q").alias("votes"))


def spans(voted: DataFrame, cover: float = COVER, drift: int = DRIFT, stretch: int = STRETCH) -> DataFrame:
    """Neighbouring diagonals merged: did, key, template, label, phrase, start, end (words, end exclusive), covered (share of
    the template's words that equal words of the span), holds (verified). Phrases and templates too short for a shift hold
    only whole and in one piece."""
    along = W.partitionBy("did", "key", "template").orderBy("diagonal")
    shift = F.when(F.col("phrase"), F.lit(0)).otherwise(F.floor(F.col("n") / drift))
    far = F.col("diagonal") - F.lag("diagonal").over(along) > shift
    d = voted.withColumn("_new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).withColumn("_span", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    seen = F.array_distinct(F.flatten(F.transform("votes", lambda q: F.sequence(q, q + F.col("k") - 1))))
    d = d.withColumn("_seen", seen)
    merged = d.groupBy("did", "key", "template", "label", "phrase", "n", "_span").agg(
        F.min(F.col("diagonal") + F.array_min("_seen")).alias("start"),
        (F.max(F.col("diagonal") + F.array_max("_seen")) + 1).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_seen")))).alias("_covered"),
    )
    enough = F.when(shift == 0, F.col("_covered") == F.col("n")).otherwise((F.col("_covered") >= cover * F.col("n")) & (F.col("end") - F.col("start") <= stretch * F.col("n")))
    return merged.select("did", "key", "template", "label", "phrase", "start", "end", (F.col("_covered") / F.col("n")).alias("covered"), enough.alias("holds"))


def scan(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places of phrases, first_word and last_word: the smallest and largest start of one (null: none); base_labels: labels
    of phrases; labels: those and the labels of templates; score: 1 if a phrase or a template holds whole, else the largest
    verified cover, 0 if nothing holds.

    A null text counts as empty and holds nothing; a null doc_id is kept. Rows are told apart by id and content, so repeated
    rows each have the same result. An empty table gives an empty result, an empty catalogue no labels. Templates without
    words are ignored; equal templates vote each. Very long texts are taken whole. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").alias("did"), F.sha2(text, 256).alias("key"), text.alias("text"))
    held = spans(diagonals(own, templates, k)).where("holds")
    place = F.when(F.col("phrase"), F.col("start"))
    joined = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    found = held.groupBy("did", "key").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("covered").alias("score"),
    )
    every = own.select("did", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.alias("e").join(found.alias("f"), F.col("e.did").eqNullSafe(F.col("f.did")) & (F.col("e.key") == F.col("f.key")), "left")
    return out.select(
        F.col("e.did").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all phrases and templates; cases of nulls, repeats and empty tables as in scan()."""
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), catalogue(spark))


_ROWS = ", ".join(f"({n}, '{x}', {str(p).lower()}, '{t}')" for n, (x, p, t) in enumerate([(a, True, b) for a, b in PHRASES] + [(a, False, b) for a, b in TEMPLATES]))
_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = rf"""
WITH c(template, label, phrase, t) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS did, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
tw AS (SELECT template, label, phrase, {_WORDS.format("t")} AS w FROM c),
t AS (SELECT *, len(w) AS n, least(len(w), {K}) AS k FROM tw),
tg AS (SELECT template, label, phrase, n, k, q - 1 AS q, array_to_string(w[q:q + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS q FROM t)),
dg AS (SELECT did, k, p - 1 AS p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT did, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM t))),
hit AS (SELECT did, template, label, phrase, n, k, q, p - q AS diag FROM dg JOIN tg USING (k, g)),
far AS (
  SELECT *, coalesce(diag - lag(diag) OVER (PARTITION BY did, template ORDER BY diag) > CASE WHEN phrase THEN 0 ELSE n // {DRIFT} END, true) AS new
  FROM (SELECT DISTINCT did, template, label, phrase, n, diag FROM hit)),
grp AS (SELECT *, sum(new::INT) OVER (PARTITION BY did, template ORDER BY diag) AS span FROM far),
cell AS (SELECT g.*, unnest(range(h.q, h.q + h.k)) AS x FROM grp g JOIN hit h USING (did, template, diag)),
merged AS (SELECT did, template, label, phrase, n, span, min(diag + x) AS s, max(diag + x) + 1 AS e, count(DISTINCT x) AS cov FROM cell GROUP BY ALL),
holds AS (SELECT *, cov / n AS covered FROM merged WHERE CASE WHEN phrase OR n < {DRIFT} THEN cov = n ELSE cov >= {COVER} * n AND e - s <= {STRETCH} * n END),
f AS (
  SELECT did, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score
  FROM holds GROUP BY did)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (did)
"""
