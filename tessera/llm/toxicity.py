"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3-, 4- and 5-grams of a lower-cased text, present or not. Naive Bayes counts, over all labelled
training texts, give each its log-count ratio. A logistic regression over all features that these texts hold, each scaled
by its ratio and fitted on all of these texts by passes over their packed features, gives the weights. A fifth of the
labelled texts is kept out of both; a line through the scores of all of these makes scores probabilities.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, totals

#: n-gram lengths, bits of the feature hash, smoothing of the counts, strength of the ridge.
GRAMS, BITS, ALPHA, RIDGE = (3, 4, 5), 18, 1.0, 1.0
#: Steps of the regression at most, far more than it takes to settle; what losses and slopes are whole numbers of.
ROUNDS, UNIT = 200, 2.0**-24
#: Bytes of text whose features make a pack; bytes of packs that a task takes in a pass; passes whose shuffles may be on disk.
PACK, TASK, PASSES = 1 << 19, 32 << 20, 10
#: Labels are sent to all tasks up to this many rows (16 MB); beyond it they are joined by a shuffle.
SENT_LABELS = 1_000_000
BATCH = 2 << 20
_BASE = 0x9E3779B97F4A7C15


def grams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The features of each text, each once. The last place of every feature is kept; an n-gram counts if it stands there."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = []
    with np.errstate(over="ignore"):
        h = code.copy()
        for n in range(2, max(GRAMS) + 1):  # a longer n-gram's number goes on from that of the shorter one
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint64(_BASE)
            h += code[n - 1 :]
            if n in GRAMS:
                x = h ^ np.uint64(n)
                x *= np.uint64(0xC2B2AE3D27D4EB4F)
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                parts.append((n, (x >> np.uint64(64 - BITS)).astype(np.int32)))
    last = np.zeros(1 << BITS, np.int32)
    turn = np.arange(3 * max([len(t) for t in low], default=0), dtype=np.int32)
    at = 0
    for t in low:
        f = np.concatenate([np.zeros(0, np.int32), *(x[at : at + len(t) - n + 1] for n, x in parts if len(t) >= n)])
        last[f] = turn[: len(f)]
        yield f[last[f] == turn[: len(f)]]
        at += len(t)


def _squeezed(f: np.ndarray) -> bytes:
    """Sorted features as bytes."""
    return np.sort(f).astype("<i4").tobytes()


class Rows:
    """Sorted features of many texts in two bytes each."""

    def __init__(self, rows: list[bytes]):
        f = np.frombuffer(b"".join(rows), "<i4")
        text = np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])
        #: Features of a text by their two upper bits.
        self.many = np.bincount(4 * text + (f >> 16), minlength=4 * len(rows)).reshape(-1, 4)
        self.low = f.astype(np.uint16)

    def packed(self) -> bytes:
        """About a byte a feature of long texts: the steps between features, and their upper bytes where these are not zero."""
        step = np.diff(self.low, prepend=np.uint16(0))
        high = (step >> 8).astype(np.uint8)
        return b"".join(x.tobytes() for x in (self.many.astype("<i4"), step.astype(np.uint8), np.packbits(high > 0), high[high > 0]))

    @classmethod
    def unpacked(cls, b: bytes, texts: int, features: int) -> Rows:
        own = cls.__new__(cls)
        own.many = np.frombuffer(b, "<i4", 4 * texts).reshape(-1, 4)
        rest = np.frombuffer(b, np.uint8, offset=16 * texts)
        bits = -(-features // 8)
        step = rest[:features].astype(np.uint16)
        step[np.flatnonzero(np.unpackbits(rest[features : features + bits], count=features))] += rest[features + bits :].astype(np.uint16) << 8
        own.low = np.cumsum(step, dtype=np.uint16)  # wraps around, as the steps do
        return own

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """The features of all texts, one text after the other; how many each text has."""
        feature = np.repeat(np.tile(np.arange(4) << 16, len(self.many)), self.many.ravel())
        feature |= self.low
        return feature, self.many.sum(1)


_PACKS = pa.schema([("toxic", pa.binary()), ("features", pa.int32()), ("pack", pa.binary())])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of some hundred texts a row, with the texts' labels as bytes."""
    for t in common.by_bytes(batches, "text", PACK):
        rows = Rows([_squeezed(f) for f in grams(t["text"].to_pylist())])
        own = t["toxic"].to_numpy().astype(np.uint8).tobytes(), len(rows.low), rows.packed()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(own, _PACKS, strict=True)], schema=_PACKS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, np.ndarray]]:
    for batch in batches:
        for toxic, features, pack in zip(*batch.columns, strict=True):
            y = np.frombuffer(toxic.as_py(), np.uint8)
            yield Rows.unpacked(pack.as_py(), len(y), features.as_py()), y


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """Texts with each feature, of class 0 and then of class 1, and the texts of each class."""
    out = None
    for rows, y in _unpacked(batches):
        out = np.zeros((2 << BITS) + 2) if out is None else out
        out[-2:] += np.bincount(y, minlength=2)
        feature, many = rows.features()
        out[:-2] += np.bincount(feature + np.repeat(y.astype(int) << BITS, many), minlength=2 << BITS)
    return out


def slopes(rows: Rows, y: np.ndarray, u: np.ndarray, b: float) -> np.ndarray:
    """Sums over texts of the logistic loss's derivatives by the weight of each feature and by the intercept, and of the loss.
    Each text's share is a whole number of UNIT: such sums are exact, so no split of the texts among tasks changes them."""
    feature, many = rows.features()
    sign, some = 2.0 * y - 1, many > 0
    margin = np.full(len(y), b)
    if len(feature):
        margin[some] += np.add.reduceat(u[feature], (np.cumsum(many) - many)[some])
    margin *= sign
    slope = np.rint(-sign / (1 + np.exp(np.clip(margin, -500, 500))) / UNIT)
    loss = np.rint(np.logaddexp(0, -margin) / UNIT)
    return np.append(np.bincount(feature, np.repeat(slope, many), len(u)), (slope.sum(), loss.sum()))


def _slopes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for rows, y in _unpacked(batches):
            own = slopes(rows, y, *shared.value)
            out = own if out is None else out + own
        return out

    return run


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Without the threads of a linear algebra library, which take more time than they save."""
    return float((a * b).sum())


def least(sums: Callable[[np.ndarray, float], np.ndarray], scale: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression by limited-memory BFGS, from what slopes() sums over
    all texts. scale is the value that each feature takes where a text has it."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = sums(w[:-1] * scale, float(w[-1])) * UNIT
        g = total[:-1]
        g[:-1] = g[:-1] * scale + ridge * w[:-1]
        return float(total[-1]) + ridge / 2 * dot(w[:-1], w[:-1]), g

    w = np.zeros(len(scale) + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = -g
        kept = []
        for s, z in reversed(past):
            a = dot(s, d) / dot(s, z)
            kept.append(a)
            d = d - a * z
        d = d * dot(*past[-1]) / dot(past[-1][1], past[-1][1]) if past else d / max(1.0, np.abs(g).sum())
        for (s, z), a in zip(past, reversed(kept), strict=True):
            d = d + (a - dot(z, d) / dot(s, z)) * s
        step = 1.0
        while True:
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * dot(g, d) or step < 1e-8:
                break
            step /= 2
        s, z = step * d, g2 - g
        w = w + s
        if dot(s, z) > 1e-12:
            past = [*past[-7:], (s, z)]
        done = abs(f - f2) <= 1e-6 * max(1.0, abs(f))
        f, g = f2, g2
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(rows: Rows, scale: np.ndarray, y: np.ndarray, ridge: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The regression over texts that are at hand."""
    return least(lambda u, b: slopes(rows, y, u, b), scale, ridge, rounds)


def logistic_of(packs: DataFrame, scale: np.ndarray, ridge: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The regression over all texts of packs: a pass over them for each step, in which only sums travel."""
    spark, passes = packs.sparkSession, itertools.count(1)

    def sums(u: np.ndarray, b: float) -> np.ndarray:
        shared = spark.sparkContext.broadcast((u, b))
        out = totals.total(packs, _slopes(shared), len(u) + 2, slices=8)
        shared.destroy()
        if next(passes) % PASSES == 0:
            common.release(spark)
        return out

    return least(sums, scale, ridge, rounds)


def calibration(scored: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the line through which numbers z become log-odds of toxic, by Newton's method over all rows;
    the slope is shrunk slightly to one. Terms are whole numbers of UNIT, as in slopes()."""
    a = np.array([1.0, 0.0])
    z = F.col("z")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z * float(a[0]) + float(a[1])))))
        off, bend = p - F.col("toxic"), p * (1 - p)
        r = scored.agg(*[F.sum(F.round(x / UNIT).cast("long")).alias(f"x{i}") for i, x in enumerate((off * z, off, bend * z * z, bend * z, bend))]).first()
        gz, g1, hzz, hz1, h11 = (float(x) * UNIT for x in r)
        g = np.array([gz, g1]) + 0.5 * (a - [1, 0])
        step = np.linalg.solve(np.array([[hzz, hz1], [hz1, h11]]) + 0.5 * np.eye(2), g)
        a = a - step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five: 0 is held out, 1 calibrates, the others are learned from. Null: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return fold(doc_id) == 0


class Model:
    """A weight for each hashed feature and an intercept."""

    def __init__(self, weight: np.ndarray, intercept: float):
        self.weight, self.intercept = weight, intercept

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.weight[f].sum() for f in grams(texts)]) + self.intercept

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def _logits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for t in common.by_bytes(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(m.logits(t["text"].to_pylist()), pa.float64()), t["toxic"].combine_chunks()], names=["z", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """Learn from all labelled rows of docs that are not held out. Labels other than 0 and 1 are ignored, and of several
    labels of a document the highest counts; repeated rows and several texts of a document count each. With no
    labelled row of either class every score is the rate of the other."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").alias("_id"), "toxic", fold(F.col("doc_id")).alias("fold")).where("toxic in (0, 1) and fold > 0")
    own = own.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    own = common.durable(own.groupBy("_id", "fold").agg(F.max("toxic").cast("int").alias("toxic")))
    sent = F.broadcast(own) if own.count() <= SENT_LABELS else own

    def joined(which: str) -> DataFrame:
        return docs.select("doc_id", "text").join(sent.where(which), F.col("doc_id") == F.col("_id")).select("text", "toxic")

    packs = common.durable(joined("fold > 1").mapInArrow(_packs, "toxic binary, features int, pack binary"))
    # a pass sends an array a task, so tasks are no more than the packs' size asks for
    held = packs.agg(F.sum(F.length("pack"))).first()[0] or 0
    packs = packs.coalesce(max(spark.sparkContext.defaultParallelism, int(held // TASK)))
    counts = totals.total(packs, _count, (2 << BITS) + 2)
    rate, (n0, n1) = counts[: 2 << BITS].reshape(2, -1), counts[-2:]
    if not n0 or not n1:
        p = min(max(n1 / max(1.0, n0 + n1), 1e-6), 1 - 1e-6) if n0 + n1 else 1e-9
        return Model(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    q, p = (rate[0] + ALPHA) / (n0 + 2 * ALPHA), (rate[1] + ALPHA) / (n1 + 2 * ALPHA)
    scale = np.where(rate.sum(0) > 0, np.log(p / q), 0.0)
    w, b = logistic_of(packs, scale, ridge)
    w = w * scale
    shared = spark.sparkContext.broadcast(Model(w, b))
    scored = common.durable(joined("fold = 1").mapInArrow(_logits(shared), "z double, toxic int"))
    a, c = 1.0, 0.0
    if len(scored.select("toxic").distinct().collect()) == 2:
        a, c = calibration(scored)
    return Model(a * w, a * b + c)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for t in common.by_bytes(batches, "text", BATCH):
            score = m.score(t["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(t["doc_id"].to_pylist(), pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text. Null and empty texts, and those below three characters, get the score of a
    text without features; a null doc_id is passed on; equal texts get equal scores; other columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def _tagged(model, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            keep = []
            at = batch.schema.get_field_index("text")
            done = 0
            for t in common.by_bytes([batch], "text", BATCH):
                keep.append(m.score(t.column(at).to_pylist()) < limit)
                done += t.num_rows
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def accepted(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **settings) -> DataFrame:
    """docs without those that a model trained on their own labelled rows scores at limit or above.

    Null and empty texts score as texts without features; rows are judged one by one, so repeated rows share their fate and
    a null doc_id is no reason to go. All columns stay as they are; an empty table gives an empty one.
    """
    model = train(docs, labels, **settings)
    return docs.mapInArrow(_tagged(docs.sparkSession.sparkContext.broadcast(model), limit), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; cases as in score(). A null doc_id counts as held out."""
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
