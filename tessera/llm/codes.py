"""Vector code compression: product quantisation in whole numbers, the same on every machine.

A component x becomes floor(1024 x). A vector is cut into equal parts; each part is coded by the nearest entry of that part's
codebook. Codebooks start as the vectors of smallest id and follow a few rounds of means, rounded down.

The nearest entry is found by a float32 matrix product. For whole numbers x, c of p components, the product in float32
differs from x.c by at most g |x| |c| with g = (p + 2) u / (1 - (p + 2) u), u = 2**-24, whatever the order of the sums (two
more roundings are those of x and c themselves). So each score has an interval; entries whose interval overlaps the best
are evaluated again in int64, and ties go to the smaller index. Where numbers are too large for int64, Python's are taken.

Spark scans the vectors once a round. A task sends sums and counts of entries, not vectors; the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Steps in which components are counted.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows that are compared with a codebook at a time: 4,096 x 256 scores.
BLOCK = 4_096
#: Whole numbers that a task holds at a time, but for a single longer vector.
CELLS = 1 << 21
#: Whole numbers are cut at this size either way, so that sums of a table fit in 38 digits.
LARGEST = 2**80
LONG = 2**63 - 1


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of doubles), label of the rows whose vector is not null and holds neither null nor non-finite
    components."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", v.alias("vector"), "label").where(F.col("vector").isNotNull() & ~F.exists("vector", bad))


def whole(vectors: pa.Array, width: int, large: bool) -> np.ndarray:
    """rows x width whole numbers; shorter vectors are filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.floor(np.clip(flat, -float(LARGEST), float(LARGEST)) * SCALE)  # a power of two: no rounding
    out = np.zeros((len(lengths), width), object if large else np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = np.clip(n, -float(LARGEST), float(LARGEST))
    out[np.repeat(np.arange(len(lengths)), lengths), at] = [int(x) for x in n] if large else n.astype(np.int64)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of book (of equal ones the first) and the squared distance, exact."""
    if x.dtype == object:
        d = np.stack([((x - c) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object) for c in book], 1)
        index = np.array([min(range(len(book)), key=lambda j: (row[j], j)) for row in d], np.int64)
        return index, d[np.arange(len(x)), index] if len(x) else np.zeros(0, object)
    index, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    u = 2.0**-24
    g = (book.shape[1] + 2) * u
    g /= 1 - g
    square = (book * book).sum(1)
    norm = np.sqrt(square.astype(float)) * (1 + 1e-12)
    low = book.astype(np.float32)
    for at in range(0, len(x), BLOCK):
        rows = x[at : at + BLOCK]
        score = square - 2.0 * (rows.astype(np.float32) @ low.T).astype(float)  # the square of the row itself is left out
        length = np.sqrt((rows * rows).sum(1).astype(float)) * (1 + 1e-12)
        # the matrix product, and the few roundings of doubles in this line and the one above
        wrong = 2 * g * length[:, None] * norm[None, :] * (1 + 1e-9) + 1e-14 * (square + np.abs(score)) + 1e-9
        near, entry = np.nonzero(score - wrong <= (score + wrong).min(1)[:, None])
        d = np.zeros(len(near), np.int64)
        room = max(1, CELLS // max(1, book.shape[1]))
        for i in range(0, len(near), room):  # many entries may be equal, so that all overlap
            apart = rows[near[i : i + room]] - book[entry[i : i + room]]
            d[i : i + room] = (apart * apart).sum(1)
        order = np.lexsort((entry, d, near))
        first = order[common.starts_of(near[order])[:-1]]  # every row has an entry
        index[at : at + BLOCK] = entry[first]
        exact[at : at + BLOCK] = d[first]
    return index, exact


def _pieces(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: the rows' numbers, entries and distances."""
    width = sum(b.shape[1] for b in books)
    x = whole(batch.column(batch.schema.get_field_index("vector")), width, books[0].dtype == object)
    at = 0
    for book in books:
        own = x[:, at : at + book.shape[1]]
        at += book.shape[1]
        yield own, *nearest(own, book)


def _sums(batches: Iterable[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    sums = [np.zeros_like(b) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in _pieces(batches, sum(b.shape[1] for b in books)):
        for part, (own, entry, _) in enumerate(_assigned(batch, books)):
            np.add.at(sums[part], entry, own)
            np.add.at(counts[part], entry, 1)
    for part, (s, n) in enumerate(zip(sums, counts, strict=True)):
        used = np.flatnonzero(n)
        if len(used):
            width = s.shape[1] + 1  # the count stands behind the components
            values = np.column_stack([s[used], n[used].astype(s.dtype)]).ravel()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(values), part, np.int32)),
                "entry": pa.array(np.repeat(used, width).astype(np.int32)),
                "place": pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)),
                "value": pa.array([str(v) for v in values]) if s.dtype == object else pa.array(values),
            })


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of kept() rows: a matrix for each part; none for an empty table.

    The first entries are the rows of smallest vec_id (null last, then by vector); with fewer rows than entries there are as
    many entries as rows. The driver gathers the first entries and, each round, entries x components sums.
    """
    size = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    longest, largest = rows.agg(F.max(F.size("vector")), F.max(size)).first()
    if longest is None:
        return []
    width = -(-longest // parts)
    # twice the largest difference, squared, summed over a vector, must fit in a long; so must a table's sums of one component
    large = (2 * (largest or 0) * SCALE + 2) ** 2 * width * parts >= 2**62 or ((largest or 0) * SCALE + 1) >= 2**26
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = whole(pa.array([r[0] for r in first], pa.list_(pa.float64())), width * parts, large)
    books = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    value = "string" if large else "long"
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        made = rows.select("vector").mapInArrow(lambda b, sent=sent: _sums(b, sent.value), f"part int, entry int, place int, value {value}")
        sums = made.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        totals = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for r in sums.collect():
            totals[r["part"]][r["entry"], r["place"]] = int(r["value"])
        books = [np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(old) for t, old in zip(total, book, strict=True)], book.dtype).reshape(book.shape) for total, book in zip(totals, books, strict=True)]
        sent.destroy()
    return books


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex sha256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def _codes(batches: Iterable[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, sum(b.shape[1] for b in books)):
        found = [(entry, d) for _, entry, d in _assigned(batch, books)]
        code = np.stack([e for e, _ in found], 1).astype(np.uint8)
        error = sum(d.astype(object) for _, d in found)
        raw = pa.array([row.tobytes() for row in code], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("label")), raw, pa.array([min(int(e), LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])


def encoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (binary, a byte a part), error (squared distances summed over the parts) of kept() rows."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    return rows.select("vec_id", "vector", "label").mapInArrow(lambda b: _codes(b, sent.value), schema)


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """codes with a column vector: the entries that the code names, as numbers of the scale of the input."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(float(v) / SCALE) for v in entry)) for entry in b)) for b in books))
    part = lambda p: F.get(F.get(tables, F.lit(p)), F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int"))
    return codes.withColumn("vector", F.concat(*(part(p) for p in range(len(books)))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (hex), error, label_error (error summed over equal labels, nulls together), codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped; other rows with a null vec_id or label, or
    with a repeated id, stay and are coded each. Vectors shorter than the longest, or than a multiple of four, count as
    filled up with zeros. Numbers of any size are exact up to 2**80; an error that no long holds is the largest long. An
    empty table, or one without a usable vector, gives an empty result. Other columns are ignored.
    """
    rows = kept(common.table(spark, sf_dir, "embeddings"))
    books = trained(rows)
    codes = common.durable(encoded(rows, books))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy("label").agg(total.alias("label_error"))
    out = codes.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT n, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS y FROM v, range({PARTS}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, n - 1 AS e, y FROM x WHERE n <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        d = "list_inner_product(x.y, x.y) - 2 * list_inner_product(x.y, b.y) + list_inner_product(b.y, b.y)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT n, p, m.d AS d, m.e AS e FROM (SELECT x.n, x.p, min(struct_pack(d := {d}, e := b.e)) AS m FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.n, x.p))")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT p, e, i, sum(z)::HUGEINT AS s, count(*) AS c FROM (SELECT a.p, a.e, unnest(range(1, len(x.y) + 1)) AS i, unnest(x.y)::BIGINT AS z FROM a{k} a JOIN x USING (n, p)) GROUP BY ALL)")
            steps.append(f"m{k} AS (SELECT p, e, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY i) AS y FROM s{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)")
    last = ROUNDS
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})")
    steps.append(f"r AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY n)")
    return (
        "WITH " + ",\n".join(steps)
        + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (n), h"
    )


SQL = _sql()
