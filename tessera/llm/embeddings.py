"""Embedding near-dedup by iterative quantisation.

A rotation of the leading principal axes is learned so that signs of the rotated vectors are balanced binary codes close
to the vectors; where the vectors have fewer dimensions than the code needs bits, further rotations are learned from other
starts, so that no bit is constant. Codes are cut into chunks; a table for each chunk is probed at every key within one
bit. Vectors meet where one's own key is a key the other probes. What meets is filtered by whole codes and then reranked
by the cosine of the original vectors in double precision.

A chunk has as many bits as the largest label's count of distinct vectors, so that a bucket of unrelated vectors holds a
bounded number of them at any size; wider chunks differ more often, and there are as many tables as keep the chance of
missing a pair at the cosine limit below a bound.

Equal vectors collapse to a class first. A bucket never lists pairs: it counts a member's links and keeps a spanning
forest of them. A large bucket is dealt as a grid of blocks, so that no task holds more than two blocks of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COSINE = 0.98
#: The bound on the vectors from which the rotation is learned, rounds of learning, seed.
SAMPLE, ROUNDS, SEED = 20_000, 30, 5
#: Least and most bits of a chunk, and the chance at which a pair of random vectors at the cosine limit may be missed.
LEAST, MOST, MISS = 16, 30, 0.006
#: The chance, by the same reckoning, at which the filter by whole codes may drop a pair at the cosine limit.
DROP = 1e-9
#: Members of a block of a bucket.
BLOCK = 2048


class Layout(NamedTuple):
    """Bits of a chunk, tables (a chunk each), and bits in which the whole codes of a candidate pair may differ."""

    width: int
    tables: int
    near: int


def layout(count: int, cosine: float = COSINE) -> Layout:
    """What a label of count vectors needs. A bit of two vectors at an angle differs with a chance of angle / pi."""
    width = min(MOST, max(LEAST, int(count - 1).bit_length()))
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = 1 if meet >= 1 else max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))
    bits, near, tail = width * tables, 0, 1.0 - (1 - p) ** (width * tables)
    while tail > DROP and near < bits:
        near += 1
        tail -= math.comb(bits, near) * p**near * (1 - p) ** (bits - near)
    return Layout(width, tables, near)


def learn(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors: principal axes, with rotations that bring signs closest, for that many bits."""
    mean = x.mean(0)
    c = x - mean
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, : min(bits, x.shape[1])]
    v = c @ axes
    r = np.random.default_rng(seed)
    found = []
    while sum(f.shape[1] for f in found) < bits:
        turn = np.linalg.qr(r.standard_normal((v.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        found.append(axes @ turn)
    # bits are dealt over the chunks in turn, so that the axes of one rotation do not fill one chunk
    return mean, np.concatenate(found, axis=1)[:, :bits]


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, of: Layout) -> np.ndarray:
    """A chunk a table for each vector."""
    signs = ((x - mean) @ projection > 0).reshape(len(x), of.width, of.tables)
    return np.einsum("nwt,w->nt", signs.astype(np.int64), 1 << np.arange(of.width, dtype=np.int64)).astype(np.int32)


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which codes of x and y differ, for all pairs of the two."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(x.T, y.T, strict=True):
        out += np.bitwise_count(a[:, None] ^ b[None])
    return out


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Codes as numbers that compare fast: two chunks in each."""
    flat = column.combine_chunks().flatten().to_numpy()
    x = flat.reshape(len(column), -1)
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), np.int32)], axis=1)
    return np.ascontiguousarray(x).view(np.uint64)


def unit(vectors: list) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors are usable, and their unit vectors in double precision."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        a = None
        if v is not None and len(v) and all(c is not None for c in v):
            a = np.asarray(v, np.float64)
            top = np.abs(a).max()
            a = a / top / np.linalg.norm(a / top) if np.isfinite(a).all() and top > 0 else None
        out.append(a)
    return np.array([a is not None for a in out], bool), out


def _coded(models: dict[int, tuple[np.ndarray, np.ndarray]], of: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, vector = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            _, units = unit(vector)
            code = np.zeros((len(cid), of.tables), np.int32)
            dim = np.array([0 if u is None else len(u) for u in units], np.int32)
            for d in np.unique(dim[dim > 0]):
                at = np.flatnonzero(dim == d)
                if int(d) not in models:  # a length that the sample lacks: random hyperplanes serve
                    models[int(d)] = np.zeros(d), np.random.default_rng(SEED + int(d)).standard_normal((d, of.width * of.tables))
                code[at] = encode(np.stack([units[i] for i in at]), *models[int(d)], of)
            chunks = pa.ListArray.from_arrays(pa.array(np.arange(len(cid) + 1, dtype=np.int32) * of.tables), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(dim), chunks], names=["cid", "dim", "code"])

    return run


def sampled(classes: DataFrame, sample: int) -> list[np.ndarray]:
    """Usable unit vectors of a bounded sample, by hash, handed over as Arrow buffers."""
    column = classes.orderBy("h", "label").limit(sample).select("vector").toArrow()["vector"]
    out = []
    for chunk in column.chunks:
        for a in range(0, len(chunk), 1024):  # Python numbers of a few vectors at a time
            out += [u.astype(np.float32) for u in unit(chunk.slice(a, 1024).to_pylist())[1] if u is not None]
    return out


_CELL = ["label", "dim", "t", "k", "i", "j"]
_CELLS = "label long, dim int, t int, k int, i int, j int"


def _first(ca: np.ndarray, cb: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of two blocks meet in table t and in none before it."""
    own = np.bitwise_count(ca[:, t][:, None] ^ cb[:, t][None]) <= 1
    for s in range(t):
        own &= np.bitwise_count(ca[:, s][:, None] ^ cb[:, s][None]) > 1
    return own


def _cells(batches: Iterator[pa.RecordBatch]):
    for t in common.grouped(batches, _CELL, 1 << 15):
        key = [t[c].to_numpy() for c in _CELL]
        cut = common.starts_of(*key)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > 1:
                yield t, [int(k[a]) for k in key], a, b


def _survive(most: int):
    """Members of a cell that are near another by their whole codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for t, key, a, b in _cells(batches):
            if t is not table:  # the columns of all cells of a table at once
                table, cids, codes, all_asks = t, t["cid"].to_numpy(), _codes(t["code"]), t["asks"].to_numpy().astype(bool)
            cid, code, asks = cids[a:b], codes[a:b], all_asks[a:b]
            x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(x) or not len(y):
                continue
            hit = np.zeros(len(cid), bool)
            for s in range(0, len(x), 256):
                p = x[s : s + 256]
                near = (differ(code[p], code[y]) <= most) & (cid[p][:, None] != cid[y][None])
                hit[p] |= near.any(1)
                hit[y] |= near.any(0)
            n = int(hit.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0], np.int64)), *[pa.array(np.full(n, v, np.int32)) for v in key[1:]], pa.array(cid[hit]), pa.array(asks[hit])], names=[*_CELL, "cid", "asks"])

    return run


def _rerank(cosine: float):
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, a, b in _cells(batches):
            own = t.slice(a, b - a)
            cid, asks, many = (own[c].to_numpy() for c in ("cid", "asks", "many"))
            asks = asks.astype(bool)
            v = np.stack(unit(own["vector"].to_pylist())[1])
            c = own["code"].combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(x) or not len(y):
                continue
            link = (v[x] @ v[y].T >= cosine) & (cid[x][:, None] != cid[y][None]) & _first(c[x], c[y], key[2])
            n = np.zeros(len(cid), np.int64)
            n[x] = link @ many[y]
            root = cid.copy()
            while True:  # the smallest label along links, until none changes
                low = np.where(link, root[y][None], common.NO_ID).min(1)
                root_x = np.minimum(root[x], low)
                low = np.where(link, root_x[:, None], common.NO_ID).min(0)
                root_y = np.minimum(root[y], low)
                if (root_x == root[x]).all() and (root_y == root[y]).all():
                    break
                root[x], root[y] = root_x, root_y
            keep = (n > 0) | (root != cid)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(cid[keep]), pa.array(n[keep]), pa.array(root[keep])], schema=schema)

    return run


def _numbered(d: DataFrame) -> DataFrame:
    """label as a number: labels that are no whole numbers are numbered."""
    if isinstance(d.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return d.withColumn("label", F.col("label").cast("long"))
    names = common.durable(d.select("label").where("label is not null").distinct().select(F.col("label").alias("_l"), F.monotonically_increasing_id().alias("_n")))
    return d.join(names, F.col("label") == F.col("_l"), "left").drop("label", "_l").withColumnRenamed("_n", "label")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors has vec_id, embedding, label. Vectors link if their labels are equal and not null, their lengths are equal
    and their cosine is at least cosine. Null, empty and zero vectors, those with null or non-finite components and those
    with a null label link with nothing. Rows of equal label and vector are members of one class and link with each
    other; rows that share a vec_id count as separate vectors. A null vec_id comes after all others and has a null
    component_id where no other vector is in its component. Labels may be of any type that can be compared. An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    n = common.partitions(vectors)
    d = vectors.select("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(common.NO_ID)).alias("vid"), F.col("embedding").alias("vector"), "label")
    d = _numbered(d)
    # equal vectors form a class with a number of its own, as different vectors may share an id or have none; low is its
    # smallest id; a hash stands for the vector in the shuffle
    d = d.withColumn("h", F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256))
    classes = d.where("label is not null and vector is not null").groupBy("label", "h").agg(F.min("vid").alias("low"), F.count("*").alias("many"), F.min_by("vector", "vid").alias("vector"))
    classes = common.durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    of = layout(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1, cosine)
    units = sampled(classes, sample)
    models = {}
    for dim in {len(u) for u in units}:
        models[dim] = learn(np.stack([u for u in units if len(u) == dim]), of.width * of.tables)
    coded = classes.select("cid", "vector").mapInArrow(_coded(models, of), "cid long, dim int, code array<int>").where("dim > 0")
    coded = common.durable(coded.join(classes, "cid").select("cid", "label", "dim", "code", "many", "vector"))

    probes = []
    for t in range(of.tables):
        own = F.get("code", F.lit(t))
        probes.append(F.struct(F.lit(t).alias("t"), own.alias("k"), F.lit(True).alias("own")))
        probes += [F.struct(F.lit(t).alias("t"), own.bitwiseXOR(F.lit(1 << b)).alias("k"), F.lit(False).alias("own")) for b in range(of.width)]
    keys = coded.select("cid", "label", "dim", "code", F.explode(F.array(*probes)).alias("p")).select("cid", "label", "dim", "code", "p.t", "p.k", "p.own")
    size = keys.groupBy("label", "dim", "t", "k").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    keys = keys.join(size, ["label", "dim", "t", "k"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = keys.where("own").select("*", block.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asks"))
    asked = keys.select("*", block.alias("j"), F.explode(every).alias("i"), F.lit(False).alias("asks"))
    cells = asking.unionByName(asked).select(*_CELL, "cid", "code", "asks")
    left = cells.repartition(n, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_survive(of.near), f"{_CELLS}, cid long, asks boolean")
    full = left.join(coded.select("cid", "code", "many", "vector"), "cid").select(*_CELL, "cid", "code", "asks", "many", "vector")
    links = common.durable(full.repartition(n, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_rerank(cosine), "cid long, n long, root long"))

    roots = common.components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    of = coded.select("cid", "many").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    of = of.select("cid", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "cid").alias("part"))
    of = classes.select("label", "h", "low", "cid").join(of, "cid")
    lowest = common.durable(of.groupBy("part").agg(F.min("low").alias("root")))
    of = of.join(lowest, "part").select("label", "h", "n_links", "root")
    out = d.select("vec_id", "vid", "label", "h").join(of, ["label", "h"], "left")
    root = F.coalesce("root", "vid")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(root < common.NO_ID, root).alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings at a cosine of 0.98; cases as in near_duplicates()."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
