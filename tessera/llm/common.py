"""What the operators of this package share: table access, durable cuts of lineage, runs of sorted rows."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside a computation: such rows come after all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else the one set on the context.

    A cluster must name one. Only a local master, where all tasks run on this machine, falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that no lost executor sends the job back before this point."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are durable and whose frames are gone. This only lowers
    the peak of disk; nothing depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1.5)  # the cleaner works in the background


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def row_id(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], room: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys; a group is never cut in two.

    A table holds about room rows, more only where one group is larger.
    """
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < room:
            continue
        whole = pa.Table.from_batches(kept)
        cut = _last_group(whole, keys)
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut).combine_chunks()
            kept = rest.to_batches()
            rows = rest.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def _last_group(t: pa.Table, keys: list[str]) -> int:
    n = t.num_rows
    last = tuple(t.column(k)[n - 1].as_py() for k in keys)
    lo, hi = 0, n - 1
    while lo < hi:  # the rows are sorted: the last group is a suffix
        mid = (lo + hi) // 2
        if tuple(t.column(k)[mid].as_py() for k in keys) == last:
            hi = mid
        else:
            lo = mid + 1
    return lo


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about most bytes of a text column each; a longer text makes a table of its own."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = np.diff(_offsets(batch.column(batch.schema.get_field_index(column))))
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max(0, most - size), side="right")))
            piece = batch.slice(at, to - at)
            kept.append(piece)
            size += int(ends[to - 1] - done)
            at = to
            if size >= most:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _offsets(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return np.zeros(1, np.int64)
    return np.frombuffer(a.buffers()[1], kind, len(a) + 1, a.offset * kind().itemsize).astype(np.int64)


def components(links: DataFrame, a: str = "a", b: str = "b", check: Callable[[int], None] | None = None) -> DataFrame:
    """Connected components by alternating large and small stars; columns: node, root (the smallest node).

    links may repeat and may hold loops. Each round only shuffles links, so its size never exceeds that of the input;
    the number of rounds is logarithmic in the longest path.
    """
    edges = durable(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    rounds = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        rounds += 1
        if check:
            check(rounds)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(edges: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    return edges.groupBy(node).agg(F.min(root).alias(root))
