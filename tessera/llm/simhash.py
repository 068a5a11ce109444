"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints within a radius r are found through 2**(r+1) - 1 bit masks: each bit position gets a non-zero vector of
r+1 bits, and the mask of a vector v holds the positions whose vector has an odd product with v. Any r positions are
missed by some mask, so two fingerprints that differ in at most r bits agree under it: no link can be lost.

Copies collapse to one fingerprint first. Buckets that are still large are cut again by masks over the bits that their
first mask leaves free, which is exact for the same reason and bounds a bucket by its free bits. A bucket never lists
its pairs: it emits links of a spanning forest, at most one a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a shingle, seed of XXH64, bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members above which a bucket is cut again.
CUT = 2048
_FULL = (1 << 64) - 1


def masks(radius: int = RADIUS, over: int = _FULL) -> list[int]:
    """Covering masks over the set bits of over; the bits' vectors are dealt in turn, so masks are balanced."""
    size = 1 << (radius + 1)
    bits = [i for i in range(64) if over >> i & 1]
    of = {b: k % (size - 1) + 1 for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if bin(of[b] & v).count("1") % 2) for v in range(1, size)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    word = (text or "").encode().lower().split()
    if not word:
        return 0
    joined = b" ".join(word)
    end = np.cumsum([len(w) + 1 for w in word]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(word) - width + 1)
    digest = xxhash.xxh64_intdigest
    code = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[len(word) - n :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(code[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([_signed(fingerprint(t, width)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), out], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _keys(fp, table: list[int], sub: bool, radius: int):
    """Rows (t, k) of a fingerprint column: the mask's number and the fingerprint under it."""
    rows = []
    for i, m in enumerate(table):
        if not sub:
            rows.append(F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")))
        else:
            for j, s in enumerate(masks(radius, _FULL & ~m)):
                rows.append(F.struct(F.lit(i * 1000 + j).alias("t"), fp.bitwiseAND(F.lit(_signed(m | s))).alias("k")))
    return F.explode(F.array(*rows))


def forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of distinct codes linked within the radius: (member, the one it was reached from)."""
    left = np.arange(1, len(codes))
    queue, a, b = [0], [], []
    while queue or len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(codes[left] ^ codes[x]) <= radius
        got = left[near]
        if len(got):
            a += got.tolist()
            b += [x] * len(got)
            queue += got.tolist()
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _link(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped(batches, ["t", "k"]):
            fp = t["fp"].to_numpy().view(np.uint64)
            cut = common.starts_of(t["t"].to_numpy(), t["k"].to_numpy())
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            parts = [(fp[two], fp[two + 1])]
            for i, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = fp[i : i + n]
                x, y = forest(own, radius)
                parts.append((own[x], own[y]))
            a, b = (np.concatenate(p).view(np.int64) for p in zip(*parts, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def links(codes: DataFrame, radius: int = RADIUS, cut: int = CUT) -> DataFrame:
    """Links (a, b) that span the components of distinct 64-bit codes (column fp) within the radius."""
    table = masks(radius)

    def meet(keys: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
        n = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        small = keys.join(n.where(F.col("n") <= most) if most else n, ["t", "k"]).select("t", "k", "fp")
        found = small.repartition(common.partitions(codes), "t", "k").sortWithinPartitions("t", "k").mapInArrow(_link(radius), "a long, b long")
        return found, n.where(F.col("n") > most) if most else None

    keys = codes.select("fp", _keys(F.col("fp"), table, False, radius).alias("x")).select("x.t", "x.k", "fp")
    found, large = meet(keys, cut)
    again = keys.join(large, ["t", "k"], "left_semi").select("fp").distinct()
    found2, _ = meet(again.select("fp", _keys(F.col("fp"), table, True, radius).alias("x")).select("x.t", "x.k", "fp"), None)
    return found.unionByName(found2).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach, itself included).

    Null and empty texts have fingerprint zero and are linked like any other; texts below width words are one shingle.
    A null doc_id comes after all others (a component of such rows only has a null component_id). Rows that repeat are
    rows of one fingerprint. An empty table gives no rows; other columns are ignored.
    """
    d = common.durable(fingerprints(docs, width))
    lows = common.durable(d.groupBy("fp").agg(F.min(common.row_id()).alias("low")))
    comp = common.components(links(lows.select("fp"), radius))
    group = lows.join(comp, lows["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("g"))
    least = group.groupBy("g").agg(F.min("low").alias("component_id"))
    of = group.join(least, "g").select("fp", "component_id")
    return d.join(of, "fp").select("doc_id", "fp", F.when(F.col("component_id") < common.NO_ID, F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id; all columns stay. Rows that share the
    kept doc_id all stay, and rows with a null doc_id stay if their component has no other. Null and empty texts are near
    duplicates of each other."""
    near = near_duplicates(docs, radius, width).select("doc_id", "component_id")
    gone = near.where("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; cases as in near_duplicates()."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
