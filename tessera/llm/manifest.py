"""Merkle manifest of a dataset, with a proof for every row.

Leaves of a tree are numbered by a range sort, so the size of a tree says how many children each of its parents has.
Building is driven by events: a child's digest reaches the partial parent of its number; a parent that holds as many
digests as its size asks for becomes a digest itself, which is an event for its own parent. Within a task this climbs as
far as the task's leaves reach. What is left, partial parents whose children lie in several tasks, is a frontier of a few
nodes a task: combineByKey brings its parts together, and the climb goes on until nothing is partial.

Finished parents keep their children's digests. These links, followed back from the root, hand every node the siblings on
its way: a join a level, each a sixteenth of the one below. Texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Children of a parent, the last one's fewer.
ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: Iterable[Column]) -> Column:
    """H of the fields: each its UTF-8 byte count, a colon and the value, or a dash for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with place (from 0, in order, null first) and size of its group, a group being rows equal in by (null is one).

    Rows are range-sorted and kept; then rows a partition and group are counted and summed up. Neither a group nor the table
    lands in one task: a hot group has a count for each partition. by may be empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]] or [F.lit(0)]
    ranged = df.repartitionByRange(common.partitions(df), *keys) if by or order else df
    kept = common.durable(ranged.withColumn("_part", F.spark_partition_id()))
    group = [f"_g{i}" for i in range(2 * len(by))]  # null as a value of its own
    for i, c in enumerate(by):
        kept = kept.withColumn(group[2 * i], F.col(c).isNull()).withColumn(group[2 * i + 1], F.coalesce(c, F.lit("")))
    counts = kept.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    along = W.partitionBy(*group).orderBy("_part")
    counts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*group)).alias("size"))
    within = W.partitionBy(*group, "_part").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    out = kept.join(counts, [*group, "_part"]).withColumn("place", F.col("_before") + F.row_number().over(within) - 1)
    return out.drop(*group, "_part", "_before")


def _due(size: int, level: int, parent: int) -> int:
    """How many children the parent has: nodes of a level are counted up from the leaves."""
    nodes = size
    for _ in range(level - 1):
        nodes = -(-nodes // ARITY)
    return min(ARITY, nodes - parent * ARITY)


def _digest(run: Iterable[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _climb(events: Iterable[tuple[int, int, int, int, dict[int, str]]]) -> Iterator[tuple]:
    """Events (tree, size, level, parent, children by place in the run) to rows (tree, size, level, number, run, digest); those
    that this task cannot finish have a null digest and their children so far, a null for each that is missing.

    Leaves come in order, so of a tree only the partial parents at the edge of what has come are held; events of a
    frontier come once a parent.
    """
    held: dict[tuple[int, int], dict[int, str]] = {}
    now: tuple[int, int] | None = None

    def left() -> Iterator[tuple]:
        tree, size = now
        for (level, parent), children in sorted(held.items()):
            yield tree, size, level, parent, [children.get(i) for i in range(_due(size, level, parent))], None

    for tree, size, level, parent, children in events:
        if now != (tree, size):
            if now:
                yield from left()
            held, now = {}, (tree, size)
        while True:
            partial = held.setdefault((level, parent), {})
            partial.update(children)
            due = _due(size, level, parent)
            if len(partial) < due:
                break
            run = [partial[i] for i in range(due)]
            del held[level, parent]
            made = _digest(run)
            yield tree, size, level, parent, run, made
            if size <= ARITY**level:  # the top
                break
            level, parent, children = level + 1, parent // ARITY, {parent % ARITY: made}
    if now:
        yield from left()


_NODE = "tree long, size long, level int, number long, run array<string>, digest string"


def parents(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, size, place, digest) of many trees: tree, size, level (from 1), number, run (the
    children's digests in order), digest. Trees of one leaf have none."""
    spark = leaves.sparkSession
    rows = leaves.where("size > 1").select("tree", "size", "place", "digest")
    events = rows.rdd.mapPartitions(lambda it: _climb((r[0], r[1], 1, r[2] // ARITY, {r[2] % ARITY: r[3]}) for r in it))
    out = common.durable(spark.createDataFrame(events, _NODE, verifySchema=False))
    made = [out.where("digest is not null")]
    open_ = out.where("digest is null")
    while not open_.isEmpty():
        partial = open_.rdd.map(lambda r: ((r["tree"], r["size"], r["level"], r["number"]), {i: d for i, d in enumerate(r["run"]) if d is not None}))
        whole = partial.combineByKey(dict, lambda a, b: {**a, **b}, lambda a, b: {**a, **b}, common.partitions(leaves))
        events = whole.mapPartitions(lambda it: _climb((*key, children) for key, children in sorted(it)))
        out = common.durable(spark.createDataFrame(events, _NODE, verifySchema=False))
        made.append(out.where("digest is not null"))
        open_ = out.where("digest is null")
    nodes = made[0]
    for m in made[1:]:
        nodes = nodes.unionByName(m)
    return nodes


def tops(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree, level, digest of the node that remains of each tree."""
    high = nodes.where((F.col("number") == 0) & (F.col("size") <= F.pow(F.lit(float(ARITY)), "level"))).select("tree", "level", "digest")
    return high.unionByName(leaves.where("size = 1").select("tree", F.lit(0).alias("level"), "digest"))


_STEP = "array<struct<left:string,right:string>>"


def _steps(run: Column, at: Column) -> Column:
    """The digests of a run on either side of one of them."""
    side = lambda start, n: F.array_join(F.slice(run, start, n), "")
    return F.array(F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.greatest(F.size(run) - at - 1, F.lit(0))).alias("right")))


def paths(leaves: DataFrame, nodes: DataFrame, above: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of leaves with place, tree, digest, top (the digest of the tree's top), path (for each level the siblings to the left and
    right, from the leaf to the top and on along the path that above gives the top) and what else above has of a tree.

    above: tree, path and more. From the root downwards a node hands its path to its children.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    handed = ["run", "top", "path", *more]
    highest = nodes.agg(F.max("level")).first()[0] or 0
    known = None  # the nodes of the level at hand that have their paths
    for level in range(highest, 0, -1):
        here = nodes.where(F.col("level") == level)
        top = F.col("size") <= F.pow(F.lit(float(ARITY)), F.lit(level))
        at = here.where(top).withColumn("top", F.col("digest")).join(above, "tree").select("tree", "number", *handed)
        if known is not None:
            at = at.unionByName(here.where(~top).join(known, ["tree", "number"]).select("tree", "number", *handed))
        if level == 1:
            known = at
            break
        each = at.select("tree", "number", *handed, F.posexplode("run").alias("_at", "_digest"))
        each = each.withColumn("path", F.concat(_steps(F.col("run"), F.col("_at")), "path")).withColumn("number", F.col("number") * ARITY + F.col("_at"))
        known = common.durable(each.select("tree", "number", "top", "path", *more))
    columns = [*keep, "place", "tree", "digest", "top", "path", *more]
    out = leaves.where("size = 1").withColumn("top", F.col("digest")).join(above, "tree").select(*columns)
    if known is not None:
        many = leaves.where("size > 1").withColumn("number", F.floor(F.col("place") / ARITY)).join(known, ["tree", "number"])
        many = many.withColumn("path", F.concat(_steps(F.col("run"), F.pmod("place", F.lit(ARITY)).cast("int")), "path"))
        out = out.unionByName(many.select(*columns))
    return out


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof(path: Column) -> Column:
    """H of all siblings on the way from a leaf to the root, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path (siblings by level from the leaf to the root, left and right of
    the way), checked (the leaf after tampering; the leaf itself where tampered, a text, is null or not given).

    docs holds doc_id, source, lang, n_chars, text. Each source is a tree of its own, a null source too, and the trees' tops
    are the leaves of one more, by source, null first. Within a source leaves go by doc_id, a null one first, then by digest:
    rows that share an id are leaves each, and equal rows have one digest, so their order does not matter. Null fields are
    dashes, empty texts are not. One source's top is the root; a source's only leaf is its top. An empty table gives no
    rows. Other columns are not part of a leaf.
    """
    fields = [F.col(c) for c in COLUMNS]
    own = leaf(fields)
    checked = own if tampered is None else F.when(tampered.isNull(), own).otherwise(leaf([*fields[:-1], tampered]))
    rows = docs.select("doc_id", "source", own.alias("digest"), checked.alias("checked"))
    placed = numbered(rows, ["source"], ["doc_id", "digest"])
    sources = numbered(placed.select("source").distinct(), [], ["source"]).select(F.col("source").alias("_source"), F.col("place").alias("tree"))
    leaves = placed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaves = common.durable(leaves.repartitionByRange(common.partitions(docs), "tree", "place").sortWithinPartitions("tree", "place"))
    nodes = parents(leaves)
    subroots = common.durable(tops(nodes, leaves))
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).cast("long").alias("size"), F.col("tree").alias("place"), "digest")
    over = common.durable(over.repartitionByRange(common.partitions(docs), "place").sortWithinPartitions("place"))
    start = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(_STEP).alias("path"))
    ways = paths(over, parents(over), start).select(F.col("place").alias("tree"), F.col("top").alias("root"), "path")
    out = paths(leaves, nodes, common.durable(ways), "doc_id", "checked")
    return out.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path", "checked")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Tampered are the documents of which 5 divides the
    crc32 of the id (a null id: none): their texts' A-Z are lowered. Cases of nulls, repeats and empty tables as in manifest()."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(common.table(spark, sf_dir, "documents"), F.when(chosen, low))
    out = out.withColumn("folded_root", folded(F.col("path"), F.col("checked")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, sha256({" || ".join(_FIELD.format(c) for c in COLUMNS)}) AS leaf,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 5 = 0
              THEN sha256({" || ".join(_FIELD.format(c) for c in COLUMNS[:-1])} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents),
l AS MATERIALIZED (SELECT *, coalesce(changed, leaf) AS checked, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
      row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id FROM d),
lev AS (
  SELECT 0 AS level, tree, place AS number, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT level + 1, tree, number, digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT level, tree, number // {ARITY} AS number, sha256(string_agg(digest, '' ORDER BY number)) AS digest FROM lev WHERE n > 1 GROUP BY level, tree, number // {ARITY})),
nodes AS MATERIALIZED (SELECT * FROM lev),
up AS (
  SELECT 0 AS level, tree AS number, digest, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, number, digest, count(*) OVER () FROM (
    SELECT level, number // {ARITY} AS number, sha256(string_agg(digest, '' ORDER BY number)) AS digest FROM up WHERE n > 1 GROUP BY level, number // {ARITY})),
every AS MATERIALIZED (SELECT level, tree, number, digest, n FROM nodes UNION ALL SELECT level, -1, number, digest, n FROM up),
runs AS MATERIALIZED (SELECT level, tree, number // {ARITY} AS parent, list(digest ORDER BY number) AS run FROM every WHERE n > 1 GROUP BY ALL),
step AS (
  SELECT id, tree AS own, tree, 0 AS level, place AS number, '' AS proof, checked AS folded, false AS done FROM l
  UNION ALL
  SELECT s.id, s.own, CASE WHEN r.run IS NULL THEN -1 ELSE s.tree END, CASE WHEN r.run IS NULL THEN 0 ELSE s.level + 1 END, CASE WHEN r.run IS NULL THEN s.own ELSE s.number // {ARITY} END,
         s.proof || coalesce(array_to_string(r.run[:s.number % {ARITY}] || r.run[s.number % {ARITY} + 2:], ''), ''),
         CASE WHEN r.run IS NULL THEN s.folded ELSE sha256(array_to_string(r.run[:s.number % {ARITY}] || [s.folded] || r.run[s.number % {ARITY} + 2:], '')) END,
         r.run IS NULL AND s.tree = -1
  FROM step s LEFT JOIN runs r ON r.tree = s.tree AND r.level = s.level AND r.parent = s.number // {ARITY} WHERE NOT s.done),
ends AS (SELECT * FROM step WHERE done)
SELECT l.doc_id, l.leaf, t.digest AS subroot, u.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = u.digest AS verified
FROM l JOIN ends e USING (id) JOIN nodes t ON t.tree = l.tree AND t.n = 1 JOIN up u ON u.n = 1
"""
