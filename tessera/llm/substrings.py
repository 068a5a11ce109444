"""Substring dedup by Rabin-Karp hashes of every fixed-length token window.

1. A task hashes all windows of its documents by prefix sums (a rolling hash of word hashes). Of windows that are equal
   within the batch only the first is sent on; the others are known to repeat, so a hot window costs a row a batch.
2. Windows are dealt by the hash's leading bits over as many buckets as the corpus needs, packed as arrays: a bucket
   holds some ten megabytes at any corpus size. A bucket counts its hashes and marks all but the first occurrence.
3. Marks return by groups of documents, merge into maximal intervals for each, and the words they cover go.

A window is compared by 56 bits of one hash of its words and by its bucket, which another hash gives. Buckets grow in
number with the corpus, not in size, so the chance of an accidental match in a bucket, about one in 100,000, stays as it
is: none are to be expected below some terabytes of text, some 150 in 100 TB (each would remove one wrong window).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Words of a window.
WINDOW = 20
#: Bytes of text that are hashed at once, and that a bucket should stand for.
BATCH, BUCKET = 4 << 20, 8 << 20
_STEP, _DEAL = 0xD1342543DE82EF95, 0xA24BAED4963EE407

_MARKS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
_GROUPS = pa.schema([("team", pa.int32()), ("docs", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary())])


def _window_codes(code: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, document number and start of all windows; documents in order."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[:-1][doc] + at
    one, two = (tokens.mix(tokens.spans_hash(code, start, width, base)) for base in (_STEP, _DEAL))
    return one, two, doc, at


def _seven(code: np.ndarray) -> bytes:
    """The lower seven bytes of each number."""
    return np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unseven(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _pack(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _hash_batches(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for t in common.by_bytes(batches, "text", BATCH):
            t = t.take(pa.compute.sort_indices(t, [("did", "ascending"), ("th", "ascending")]))
            did, th = t["did"].to_numpy(), t["th"].to_numpy()
            _, _, code, first = tokens.words(*tokens.buffer(t["text"]))
            code, deal, doc, at = _window_codes(code, first, width)
            if not len(code):
                continue
            order = tokens.packed(code)
            group = np.empty(len(code), np.int64)
            cut = common.starts_of(code[order])
            group[order] = np.repeat(order[cut[:-1]], np.diff(cut))
            # a row of the same document and place is another copy of the same occurrence
            later = (did[doc] != did[doc[group]]) | (at != at[group])
            rows = []
            if later.any():
                rows.append((-1 - turn % buckets, *_docs(did, th, doc[later], at[later], "<i8"), b""))
            send = np.flatnonzero(~later)  # the first and its copies, which get its fate
            bucket = ((deal[send] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")  # documents stay in order
            send, bucket = send[order], bucket[order]
            cuts = common.starts_of(bucket)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s = send[i:j]
                rows.append((int(bucket[i]), *_docs(did, th, doc[s], at[s], "<i8"), _seven(code[s])))
            for i in range(0, len(rows), 256):
                yield _pack(_MARKS, rows[i : i + 256])
            turn += 1

    return run


def _docs(did, th, doc, at, kind="<i4") -> tuple[bytes, bytes, bytes]:
    """Documents, starts (as steps within a document) and starts a document: small numbers, which shuffles compress.
    The documents come in order."""
    cut = common.starts_of(doc)
    step = np.diff(at, prepend=0)
    step[cut[:-1]] = at[cut[:-1]]
    which = doc[cut[:-1]]
    return th[which].astype(kind).tobytes() + _thin(np.diff(did[which], prepend=0)), _thin(step), _thin(np.diff(cut))


def _thin(x: np.ndarray) -> bytes:
    """Numbers below 254 as bytes; others marked by 254, with two bytes kept apart, or by 255, with eight."""
    x = x.astype(np.int64)
    small = np.where((x >= 0) & (x < 254), x, np.where((x >= 0) & (x < 1 << 16), 254, 255)).astype(np.uint8)
    mid = x[small == 254].astype("<u2").tobytes()
    return len(x).to_bytes(4, "little") + small.tobytes() + mid + x[small == 255].astype("<i8").tobytes()


def _wide(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    small = np.frombuffer(b, np.uint8, n, 4)
    x = small.astype(np.int64)
    mid = small == 254
    k = 2 * int(mid.sum())
    x[mid] = np.frombuffer(b, "<u2", k // 2, 4 + n)
    x[small == 255] = np.frombuffer(b, "<i8", -1, 4 + n + k)
    return x


def _undocs(docs: bytes, marks: bytes, counts: bytes, kind="<i4") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, step = _wide(counts), _wide(marks)
    th, did = np.frombuffer(docs, kind, len(n)).astype(np.int64), np.cumsum(_wide(docs[np.dtype(kind).itemsize * len(n) :]))
    at = np.cumsum(step)
    begin = np.cumsum(n) - n
    at -= np.repeat(at[begin] - step[begin], n)
    return np.repeat(did, n), np.repeat(th, n), at


def _count_buckets(teams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for did, th, at, code in _buckets(batches, "<i8", _unseven):
            if code is not None:
                order = tokens.exact(code, 56)
                cut = common.starts_of(code[order])
                order = order[np.repeat(np.diff(cut) > 1, np.diff(cut))]  # windows that occur once need no further look
                order = order[np.lexsort((at[order], did[order], code[order]))]
                did, th, at, code = did[order], th[order], at[order], code[order]
                head = common.starts_of(code)[:-1]
                group = np.repeat(head, np.diff(np.append(head, len(code))))
                keep = (did != did[group]) | (at != at[group])
                did, th, at = did[keep], th[keep], at[keep]
            if len(did):
                yield _teamed(did, th, at, teams, "<i8")

    return run


def _teamed(did, th, at, teams: int, kind="<i4") -> pa.RecordBatch:
    """Marks packed for each team of documents, which the leading bits of a hash of a document name.

    Marks of a document come in order of place from the one batch that holds it, so sorting by the hash alone is enough.
    """
    h = tokens.mix(did.view(np.uint64) ^ tokens.mix(th.view(np.uint64)))
    order = tokens.packed(h)
    did, th, at = did[order], th[order], at[order]
    team = ((h[order] >> np.uint64(48)) * np.uint64(teams) >> np.uint64(16)).astype(np.int64)
    cut = common.starts_of(team)
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        d, h = did[a:b], th[a:b]
        doc = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) - 1
        first = common.starts_of(doc)[:-1]
        rows.append((int(team[a]), *_docs(d[first], h[first], doc, at[a:b], kind)))
    return _pack(_GROUPS, rows)


def gathered(kind: str = "<i4"):
    """The marks of each document of a team, whose rows arrive together."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int32() if kind == "<i4" else pa.int64()), ("starts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for team, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if team != now and parts:
                    yield from _found(schema, *map(np.concatenate, zip(*parts, strict=True)))
                    parts = []
                now = team
                parts.append(_undocs(*packed, kind))
        if parts:
            yield from _found(schema, *map(np.concatenate, zip(*parts, strict=True)))

    return run


def _buckets(batches: Iterator[pa.RecordBatch], kind, unpack):
    """What each bucket holds; rows arrive sorted by bucket, and those of one bucket are decoded together."""
    now, parts = None, []
    for batch in batches:
        for bucket, docs, marks, counts, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket < 0:
                yield *_undocs(docs, marks, counts, kind), None
                continue
            if bucket != now and parts:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            now = bucket
            parts.append((*_undocs(docs, marks, counts, kind), unpack(codes)))
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _found(schema, did, th, at) -> Iterator[pa.RecordBatch]:
    """The sorted distinct marks of each document."""
    order = tokens.exact(did.astype(np.uint64))
    did, th, at = did[order], th[order], at[order]
    cut = common.starts_of(did, th)
    if len(cut) - 1 > len(common.starts_of(did)) - 1:  # versions that share an id
        order = np.lexsort((th, did))
        did, th, at = did[order], th[order], at[order]
        cut = common.starts_of(did, th)
    first = cut[:-1]
    doc = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(cut))
    both = np.sort(doc << np.uint64(32) | at.astype(np.uint64))  # places are below 2**32
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    edge = np.searchsorted(both, np.arange(len(first) + 1, dtype=np.uint64) << np.uint64(32))
    at = (both & np.uint64(0xFFFFFFFF)).astype("<u4").astype("<i4")
    rows = [(int(did[i]), int(th[i]), at[a:b].tobytes()) for i, a, b in zip(first, edge[:-1], edge[1:], strict=True)]
    for i in range(0, len(rows), 4096):
        yield _pack(schema, rows[i : i + 4096])


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals that windows from these starts cover."""
    if not len(starts):
        return []
    s = np.unique(starts)
    cut = np.flatnonzero(np.diff(s) > width) + 1
    return [(int(a[0]), int(a[-1]) + width) for a in np.split(s, cut)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])


def _remove(width: int, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word = (raw or "").encode().split()
                spans = intervals(np.frombuffer(starts, "<i4"), width) if starts else []
                kept, last = [], 0
                for a, b in spans:
                    kept += word[last:a]
                    last = b
                kept += word[last:]
                out = b" ".join(kept)
                rows.append((doc_id, len(word), len(word) - len(kept), len(spans), out.decode() if text else hashlib.sha256(out).hexdigest()))
            if rows:
                yield _pack(_OUT, rows)

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, text: bool = True, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept: each document without words that a repeated window covers.

    A window of width words is repeated if its words also start earlier: in a document with a smaller doc_id, or in the
    same document before. Windows are judged on the input; kept joins what stays by one space (with text=False its
    SHA-256 in hex).

    Null and empty texts have no words and keep none. Rows with a null doc_id come after all others, as one document.
    Rows that share a doc_id are versions of one document: a window is no repeat of the same place in another version;
    rows that are equal get equal results. Texts below width words are never touched; an empty table gives no rows.
    Other columns are ignored.
    """
    d = docs.select("doc_id", common.row_id().alias("did"), F.xxhash64(F.sha2("text", 256)).alias("th"), "text")
    if buckets is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(16, -(-size // BUCKET))
    teams = 16 * math.isqrt(buckets)
    marks = d.select("did", "th", "text").mapInArrow(_hash_batches(width, buckets), "bucket int, docs binary, marks binary, counts binary, codes binary")
    # a bucket is a partition, up to a bound on partitions
    parts = min(buckets, 50_000)
    found = marks.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_count_buckets(teams), "team int, docs binary, marks binary, counts binary")
    parts = min(teams, 50_000)
    found = found.repartitionById(parts, F.pmod("team", F.lit(parts))).sortWithinPartitions("team").mapInArrow(gathered("<i8"), "did long, th long, starts binary")
    both = d.join(found, ["did", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts")
    return both.mapInArrow(_remove(width, text), "doc_id long, n_words long, n_removed long, n_spans long, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words in all documents, with a digest of what stays; cases as in remove_repeats()."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"), text=False)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM rep)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
