"""Suffix-array dedup: a distributed difference-cover sort of the suffixes that can repeat.

A suffix matters only to its first WIDTH bytes, so all ranks are ranks of bounded prefixes.

0. Minimizers: of every WIDTH-byte string the smallest hash of its GRAM-byte substrings is chosen. Equal strings choose
   equal substrings, so text without a chosen substring that another text has too cannot repeat; it is left out. Of equal
   whole texts only the one with the smallest doc_id takes part: all others are repeats of it.
1. What is left lies in batches, similar pieces together. Positions i with i mod 3 in {1, 2} (a difference cover modulo 3)
   are sampled; triples of 8-byte words at them are sorted by a range partition, and their ranks are 24-byte names.
2. The recursion: pairs of names 24 bytes apart (a multiple of 3, so both are samples) are sorted into 48-byte names.
3. All suffixes are merged. Any two have an offset below 3 from which both are samples, so two bytes and a name compare
   them; each range of prefixes is merged by one task.
4. Adjacent suffixes of the merged order with equal WIDTH-byte prefixes form a group; every occurrence outside the
   group's smallest document is a repeat. Only one bit for each string and batch travels back.

Each batch sends a string once, however often it holds it, so a passage in a third of all documents costs a row a batch.
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

from . import common, substrings, tokens
from .substrings import _pack

WIDTH, NAME, GRAM = 50, 24, 32
#: One in so many chosen substrings also cuts pieces, so that equal content lies in pieces that begin alike.
ANCHOR = 64
#: Bytes of text that a task hashes at once, of a batch of pieces, and that a bucket of substrings stands for.
HASHED, BATCH, BUCKET = 2 << 20, 1 << 20, 16 << 20
#: Bound on the batches from which the ranges are cut, and numbers taken of each.
SAMPLED, CUTS = 2000, 64
_STEP = 0xA0761D6478BD642F
_LAST = np.uint32(2**32 - 1)


# --- 0. minimizers


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of x[i:i+n] at every i, by doubling; the result is n - 1 shorter."""
    have, width = x, 1
    while width * 2 <= n:
        have = best(have[:-width], have[width:])
        width *= 2
    return best(have[: len(x) - n + 1], have[n - width : n - width + len(x) - n + 1]) if n > width else have


def minimizers(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the chosen substrings; texts end a byte before the next begins.

    Strings are looked at chunk by chunk, whatever texts they are of, so memory does not grow with the texts. The upper
    half of a hash decides the choice; what is returned is mixed once more, so that chosen hashes are spread evenly.
    """
    span = WIDTH - GRAM + 1
    places, codes = [], []
    ends = offsets[1:] - 1
    for a in range(0, len(data) - WIDTH + 1, chunk):
        own = data[a : a + chunk + WIDTH - 1]
        code = _grams(own)
        low = (code >> np.uint64(32)).astype(np.uint32)
        near = ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + len(own))] - a
        for e in near.tolist():  # a substring over the end of a text is never chosen
            low[max(0, e - GRAM + 1) : e + 1] = _LAST
        best = _slide(low, span, np.minimum)
        for e in near.tolist():  # nor does a string over the end choose
            best[max(0, e - WIDTH + 1) : e + 1] = 0
        padded = np.zeros(len(best) + 2 * span - 2, np.uint32)
        padded[span - 1 : span - 1 + len(best)] = best
        at = np.flatnonzero((_slide(padded, span, np.maximum) == low) & (low != _LAST))
        places.append(at + a)
        codes.append(code[at])
    at, first = np.unique(np.concatenate([np.zeros(0, np.int64), *places]), return_index=True)
    doc = np.searchsorted(offsets, at, side="right") - 1
    return doc, at - offsets[doc], tokens.mix(np.concatenate([np.zeros(0, np.uint64), *codes])[first])


def _grams(own: np.ndarray, size: int = GRAM, mixed: bool = True) -> np.ndarray:
    """A hash of every substring of so many bytes; to tell them apart it need not be mixed."""
    n = len(own)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        x = own.astype(np.uint64)
        x += np.uint64(1)
        x *= tokens.powers(_STEP, n)
        np.cumsum(x, out=prefix[1:])
        x = prefix[size:] - prefix[:-size]
        x *= tokens.powers(pow(_STEP, -1, 2**64), n)[: len(x)]
    return tokens.mix(x) if mixed else x


def _mark_batches(buckets: int, teams: int):
    """Chosen substrings by bucket. Of a hash 32 bits travel beside the bucket's number: buckets grow in number with the
    corpus, not in size, so an accidental match, which only lets text through that does not repeat, stays as rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.by_bytes(batches, "text", HASHED):
            t = t.take(pa.compute.sort_indices(t, [("did", "ascending"), ("th", "ascending")]))
            th = t["th"].to_numpy()
            once = np.sort(np.unique(th, return_index=True)[1])  # the smallest doc_id stands for equal texts
            t = t.take(pa.array(once))
            did, th = t["did"].to_numpy(), t["th"].to_numpy()
            doc, at, code = minimizers(*tokens.buffer(t["text"]))
            if not len(code):
                continue
            bucket = (code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            key = bucket << np.uint64(32) | code & np.uint64(0xFFFFFFFF)
            order = np.argsort(key)
            cut = common.starts_of(key[order])
            size = np.diff(cut)
            first, final = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
            first[order], final[order] = (np.repeat(f.reduceat(doc[order], cut[:-1]), size) for f in (np.minimum, np.maximum))
            many = first != final  # known to repeat: marked here, and two documents speak for all
            rows = []
            if many.any():
                rows.append((-1 - int(did[0] % buckets), *substrings._docs(did, th, doc[many], at[many], "<i8"), b""))
            send = np.flatnonzero((doc == first) | (doc == final))
            send = send[np.argsort(bucket[send].astype(np.uint16 if buckets < 1 << 16 else np.uint64), kind="stable")]  # documents stay in order
            cuts = np.append(np.flatnonzero(np.diff(bucket[send], prepend=np.uint64(buckets))), len(send))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s = send[i:j]
                rows.append((int(bucket[s[0]]), *substrings._docs(did, th, doc[s], at[s], "<i8"), code[s].astype("<u4").tobytes()))
            for i in range(0, len(rows), 256):
                yield _pack(substrings._MARKS, rows[i : i + 256])

    return run


def _mark_buckets(teams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for did, th, at, code in substrings._buckets(batches, "<i8", lambda b: np.frombuffer(b, "<u4")):
            if code is not None:
                order = np.argsort(code)
                cut = common.starts_of(code[order])
                keep = order[np.repeat(np.minimum.reduceat(th[order], cut[:-1]) != np.maximum.reduceat(th[order], cut[:-1]), np.diff(cut))]
                did, th, at = did[keep], th[keep], at[keep]
            if len(did):
                yield substrings._teamed(did, th, at, teams, "<i8")

    return run


_PIECES = pa.schema([("key", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("off", pa.int64()), ("piece", pa.binary())])


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a text that marked substrings, or strings around them, cover, cut at anchors among the marked.

    A piece overlaps the next by a byte less than a string, so that each string lies in one piece, by where it starts.
    """
    for batch in batches:
        did_, th_, text_, starts_ = batch.columns
        found: list[list] = [[], [], [], []]  # key, number of the row, place, piece
        for n, (raw, starts) in enumerate(zip(text_.cast(pa.large_binary()).to_pylist(), starts_.to_pylist(), strict=True)):
            data = np.frombuffer(raw, np.uint8)
            at = np.frombuffer(starts, "<i4").astype(np.int64)
            code = np.concatenate([_codes(data, p) for p in np.split(at, np.arange(8192, len(at), 8192))]) if len(at) > 8192 else _codes(data, at)
            far = np.append(0, np.flatnonzero(np.diff(at) > 2 * WIDTH - GRAM) + 1)  # where a run of marks begins
            run = np.zeros(len(at), np.int64)
            run[far[1:]] = 1
            run = np.cumsum(run)
            begin = np.maximum(0, at[far] + GRAM - WIDTH)
            end = np.minimum(len(raw), at[np.append(far[1:], len(at)) - 1] + WIDTH) - WIDTH + 1
            anchor = np.flatnonzero(code % np.uint64(ANCHOR) == 0)
            start = np.concatenate([begin, at[anchor]])
            of = np.concatenate([np.arange(len(far)), run[anchor]])
            key = np.concatenate([np.minimum.reduceat(code, far), code[anchor]])
            order = np.lexsort((start, of))
            start, of, key = start[order], of[order], key[order]
            stop = np.where(np.append(of[1:] == of[:-1], False), np.append(start[1:], 0), end[of])
            keep = stop > start
            start, stop = start[keep].tolist(), stop[keep].tolist()
            found[0].append(key[keep] >> np.uint64(1))
            found[1].append(np.full(len(start), n))
            found[2] += start
            found[3] += [raw[a : b + WIDTH - 1] for a, b in zip(start, stop, strict=True)]
        if not found[3]:
            continue
        row = pa.array(np.concatenate(found[1]))
        columns = [pa.array(np.concatenate(found[0]).astype(np.int64)), did_.take(row), th_.take(row), pa.array(found[2], pa.int64()), pa.array(found[3], pa.binary())]
        whole = pa.RecordBatch.from_arrays(columns, schema=_PIECES)
        for i in range(0, whole.num_rows, 4096):
            yield whole.slice(i, 4096)


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the substrings at these places, in order of place."""
    if not len(at):
        return np.zeros(0, np.uint64)
    own = data[at[0] : at[-1] + GRAM].astype(np.uint64) + np.uint64(1)
    return tokens.mix(tokens.spans_hash(own, at - at[0], GRAM, _STEP))


def _squeezed(raw: bytes) -> bytes:
    """Compressed bytes behind their length: checkpoints keep rows as they are, and shuffles compress without entropy coding."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[4:], int.from_bytes(b[:4], "little"), codec="zstd", asbytes=True)


_BATCHES = pa.schema([("bid", pa.int64()), ("size", pa.int64()), ("meta", pa.binary()), ("data", pa.binary())])


def _gather_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    for turn, t in enumerate(common.by_bytes(batches, "piece", BATCH)):
        pieces = t["piece"].to_pylist()
        meta = np.stack([t["did"].to_numpy(), t["th"].to_numpy(), t["off"].to_numpy(), np.array([len(p) for p in pieces])])
        yield _pack(_BATCHES, [(base + turn, int(meta[3].sum()), _squeezed(meta.astype("<i8").tobytes()), _squeezed(b"".join(pieces)))])


class Batch:
    """Pieces end to end, and the places in them."""

    def __init__(self, meta: bytes, data: bytes):
        self.did, self.th, self.off, size = np.frombuffer(meta, "<i8").reshape(4, -1)
        self.data = np.frombuffer(data + bytes(8), np.uint8)
        n = int(size.sum())
        size = size.astype(np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        self.piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = np.arange(n, dtype=np.int32) - begin[self.piece]
        self.left = size[self.piece] - self.place
        self.turn = (self.place % 3).astype(np.int8)

    @classmethod
    def of(cls, meta: bytes, data: bytes) -> Batch:
        return cls(_unsqueezed(meta), _unsqueezed(data))

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as a number that orders like them."""
        return np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))[at].astype(np.uint64)

    def samples(self, length: int) -> np.ndarray:
        return np.flatnonzero((self.turn != 0) & (self.left >= length))


def _digest(keys: list[np.ndarray]) -> np.ndarray:
    """A hash of each row. Numbers are mixed one after the other: a plain sum of products would take strings that differ in
    letters eight apart for equal."""
    h = tokens.mix(keys[0])
    with np.errstate(over="ignore"):
        for k in keys[1:]:
            h = tokens.mix(h * np.uint64(0x9E3779B97F4A7C15) + k)
    return h


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by group, where each group begins, and the number of each row's group, for groups of equal hashes. Should two
    hashes differ in their low bits only, a group may come in parts; then each part is sent and answered."""
    order = tokens.packed(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


#: What of a first number decides its range and its place in what is sent: words of a batch and their places are sorted as
#: one number.
_HEAD = np.uint64((1 << 64) - (1 << 24))


def _distinct(keys: list[np.ndarray], named: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence of each distinct key, by their first numbers; the place in that order of each row's key).

    Ranges are ranges of first numbers, so the order is one of ranges too. Neighbours are alike, as their ranks will be,
    and compress well. Numbers that are names are put together from range and rank.
    """
    order, new, which = _groups(_digest(keys))
    first = order[new]
    x, top = keys[0][first], 64
    if named and len(x):
        rank = x & np.uint64(0xFFFFFFFF)
        x = x >> np.uint64(32) << np.uint64(int(rank.max()).bit_length()) | rank
        top = int(x.max()).bit_length()
    sent = tokens.packed(x, top)
    place = np.empty_like(sent)
    place[sent] = np.arange(len(sent))
    return first[sent], place[which]


def ranks(keys: list[np.ndarray]) -> np.ndarray:
    """How many rows come before each row, by their keys in turn; equal rows get equal numbers. After each key only rows
    that are still tied go on."""
    n = len(keys[0])
    out = np.zeros(n, np.int64)
    todo, start = np.arange(n), np.zeros(1, np.int64)
    group = np.zeros(n, np.int64)  # of the rows still tied, in order of groups
    for k in keys:
        order = np.argsort(k[todo])
        own = k[todo[order]]
        dense = np.empty(len(todo), np.uint64)
        dense[order] = np.cumsum(np.append(False, own[1:] != own[:-1])) if len(own) else 0
        bits = max(1, (len(todo) - 1).bit_length())
        if len(start) > 1:
            order = tokens.packed(group.astype(np.uint64) << np.uint64(bits) | dense, 2 * bits)
            if 3 * bits > 64:
                order = np.lexsort((dense, group))
        todo, group, dense = todo[order], group[order], dense[order]
        new = np.append(True, (group[1:] != group[:-1]) | (dense[1:] != dense[:-1]))[: len(todo)]
        head = np.flatnonzero(new)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(todo)])  # of the groups before this key
        out_head = start[group[head]] + head - begin[group[head]]
        size = np.diff(np.append(head, len(todo)))
        out[todo] = np.repeat(out_head, size)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        todo, start = todo[tied], out_head[size > 1]
        group = np.repeat(np.arange(len(start)), size[size > 1])
    return out


def _triples(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    at = b.samples(NAME)
    keys = [b.word(at + 8 * j) for j in range(3)]
    first, inverse = _distinct(keys)
    return at, first, inverse, keys


_SENT = pa.schema([("part", pa.int32()), ("bid", pa.int64()), ("keys", pa.binary())])
_RANKS = pa.schema([("bid", pa.int64()), ("part", pa.int32()), ("ranks", pa.binary())])


def _send(bid: int, part: np.ndarray, keys: list[np.ndarray], pack) -> pa.RecordBatch | None:
    cut = common.starts_of(part)
    rows = [(int(part[a]), bid, pack([k[a:b] for k in keys])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return _pack(_SENT, rows) if rows else None


def _pack_triples(keys: list[np.ndarray]) -> bytes:
    """Bytes of text in order, a row each."""
    return _squeezed(np.stack(keys, axis=1).astype(">u8").tobytes())


def _unpack_triples(part: int, row: bytes) -> np.ndarray:
    return np.frombuffer(_unsqueezed(row), ">u8").reshape(-1, 3).T.astype(np.uint64)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """First all lowest bytes, then all next ones: the high bytes of small numbers are runs of zeros, which compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(b: bytes, n: int, at: int = 0, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, width * n, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack_pairs(keys: list[np.ndarray]) -> bytes:
    return _squeezed(_planes(np.diff(keys[0], prepend=np.uint64(0))) + _planes(keys[1]))


def _unpack_pairs(part: int, row: bytes) -> np.ndarray:
    raw = _unsqueezed(row)
    n = len(raw) // 16
    return np.stack([np.cumsum(_unplanes(raw, n)), _unplanes(raw, n, 8 * n)])


def _pack_ranks(rank: np.ndarray) -> bytes:
    """Steps from rank to rank, small ones either way: keys come nearly in order."""
    step = np.diff(rank.astype(np.int64), prepend=0)
    return _squeezed(_planes((step << 1) ^ (step >> 63), 5))


def _unpack_ranks(row: bytes) -> np.ndarray:
    raw = _unsqueezed(row)
    n = len(raw) // 5
    step = _unplanes(raw, n, 0, 5)
    return np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64))


def _rank(unpack):
    """Ranks of the keys of a range, for each batch in the order in which it sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            sent = [unpack(part, k) for _, k in rows]
            rank = ranks(list(np.concatenate(sent, axis=1)))
            at = 0
            for (bid, _), s in zip(rows, sent, strict=True):
                yield _pack(_RANKS, [(bid, part, _pack_ranks(rank[at : at + s.shape[1]]))])
                at += s.shape[1]

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    now, rows = None, []
    for batch in batches:
        for part, bid, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and rows:
                yield now, rows
                rows = []
            now = part
            rows.append((bid, keys))
    if rows:
        yield now, rows


def _names(replies) -> np.ndarray:
    """Names of a batch's distinct keys, in order: range and rank in it."""
    parts = sorted((r["part"], r["ranks"]) for r in replies or [])
    return np.concatenate([np.zeros(0, np.uint64), *((np.uint64(p) << np.uint64(32)) | _unpack_ranks(r).astype(np.uint64) for p, r in parts)])


def _cuts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, meta, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = Batch.of(meta, data)
            w = np.sort(b.word(np.flatnonzero(b.left >= WIDTH)))
            w = w[np.linspace(0, len(w) - 1, CUTS).astype(int)] if len(w) else w
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["cuts"])


def _send_triples(ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, meta, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, first, _, keys = _triples(Batch.of(meta, data))
                out = _send(bid, _range(ranges, keys[0][first]), [k[first] for k in keys], _pack_triples)
                if out:
                    yield out

    return run


def _pairs(b: Batch, replies) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    at, _, inverse, _ = _triples(b)
    name = np.zeros(len(b.piece), np.uint64)
    name[at] = _names(replies)[inverse]
    at = b.samples(2 * NAME)
    keys = [name[at], name[at + NAME]]
    first, inverse = _distinct(keys, named=True)
    return at, first, inverse, keys


def _send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bid, meta, data, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, first, _, keys = _pairs(Batch.of(meta, data), names)
            out = _send(bid, (keys[0][first] >> np.uint64(32)).astype(np.int64), [k[first] for k in keys], _pack_pairs)
            if out:
                yield out


def _range(ranges: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The range of strings that begin with a word; words that differ behind _HEAD only share one."""
    return np.searchsorted(ranges, word & _HEAD, side="right")


def _strings(b: Batch, ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """All whole strings: places, number of each one's distinct string; and for each distinct string, in the order in
    which they are sent (by range and smallest document), a place of it, its range and its smallest document."""
    at = np.flatnonzero(b.left >= WIDTH)
    if not len(at):
        return at, at, at, at, at
    h = _grams(b.data, WIDTH, False)[at]
    order, new, which = _groups(h)
    dids, rank = np.unique(b.did, return_inverse=True)  # of pieces, which are few
    low = np.minimum.reduceat(rank[b.piece[at[order]]], new)
    did, head = dids[low], at[order[new]]
    part = _range(ranges, b.word(head))
    sent = tokens.packed(part.astype(np.uint64) << np.uint64(24) | low.astype(np.uint64), 40)
    place = np.empty_like(sent)
    place[sent] = np.arange(len(sent))
    return at, place[which], head[sent], part[sent], did[sent]


def _send_suffixes(ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, meta, data, names, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Batch.of(meta, data)
                at, _, inverse, _ = _pairs(b, names)
                name = np.zeros(len(b.piece) + 3, np.uint64)
                name[at] = _names(pairs)[inverse]
                _, _, head, part, did = _strings(b, ranges)
                turn = b.turn[head]
                # the two of a place and its two successors that are samples
                x = np.where(turn == 2, name[head], name[head + 1])
                y = np.where(turn == 1, name[head], name[head + 2])
                ends = [b.data[head + j] for j in (0, 1, WIDTH - 2, WIDTH - 1)]
                cut = common.starts_of(part)
                rows = [(int(part[s]), bid, _suffix_row(turn[s:e], x[s:e], y[s:e], [z[s:e] for z in ends], did[s:e])) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                if rows:
                    yield _pack(_SENT, rows)

    return run


def _suffix_row(turn, x, y, ends, did) -> bytes:
    parts = [len(turn).to_bytes(4, "little"), turn.astype(np.uint8).tobytes(), *(z.tobytes() for z in ends)]
    return _squeezed(b"".join([*parts, _planes(x), _planes(y), _planes(np.diff(did, prepend=0))]))


def _suffix_columns(row: bytes) -> list[np.ndarray]:
    row = _unsqueezed(row)
    n = int.from_bytes(row[:4], "little")
    turn, b0, b1, b48, b49 = (np.frombuffer(row, np.uint8, n, 4 + n * k) for k in range(5))
    x, y, step = (_unplanes(row, n, 4 + 5 * n + 8 * n * k) for k in range(3))
    return [turn, x, y, b0, b1, b48, b49, np.cumsum(step.view(np.int64))]


#: Of two turns, which comparison both have: 0 by the successor, 1 by the one after it, 2 by the place itself.
_SHARED = np.array([[0, 0, 1], [0, 0, 2], [1, 2, 1]])


def merged(turn, x, y, b0, b1, b48, b49) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their prefixes, and where in that order a new prefix begins.

    A name takes 48 bits (a range below 2**16 and a rank in it), so a comparison by two bytes and a name is one number.
    """
    n = len(turn)
    b0, b1, b48, b49 = (b.astype(np.uint64) for b in (b0, b1, b48, b49))
    s = np.uint64
    # turns 0 and 1 compare by a byte, the successor's name, a byte; 0 and 2 by two bytes and a name; 1 and 2 by their own names
    keys = [b0 << s(56) | x << s(8) | b49, b0 << s(56) | b1 << s(48) | y, np.where(turn == 1, y, x) << s(16) | b48 << s(8) | b49]
    rows = [(own := np.flatnonzero(turn == c))[np.argsort(keys[k][own])] for c, k in ((0, 0), (1, 0), (2, 1))]
    place = np.empty(n, np.int64)
    for c in range(3):
        at = np.arange(len(rows[c]))
        for o in range(3):
            if o != c:  # ties go by turn
                k = keys[_SHARED[c, o]]
                at = at + np.searchsorted(k[rows[o]], k[rows[c]], side="right" if o < c else "left")
        place[rows[c]] = at
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    a, b = order[:-1], order[1:]
    same = np.choose(_SHARED[turn[a], turn[b]], [k[a] == k[b] for k in keys])
    return order, np.append(True, ~same) if n else np.zeros(0, bool)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        sent = [_suffix_columns(k) for _, k in rows]
        *columns, did = map(np.concatenate, zip(*sent, strict=True))
        order, new = merged(*columns)
        head = np.flatnonzero(new)
        low = np.repeat(np.minimum.reduceat(did[order], head), np.diff(np.append(head, len(order))))
        late = np.empty(len(order), bool)
        late[order] = did[order] > low
        at = 0
        for (bid, _), s in zip(rows, sent, strict=True):
            yield _pack(_RANKS, [(bid, part, np.packbits(late[at : at + len(s[0])]).tobytes())])
            at += len(s[0])


_RUNS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("starts", pa.binary())])


def _repeats(ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, meta, data, replies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Batch.of(meta, data)
                at, string, _, part, low = _strings(b, ranges)
                late = np.zeros(len(part), bool)
                for r in replies or []:
                    s, e = np.searchsorted(part, [r["part"], r["part"] + 1])
                    late[s:e] = np.unpackbits(np.frombuffer(r["ranks"], np.uint8), count=e - s)
                hit = late[string] | (b.did[b.piece[at]] > low[string])
                at = at[hit]
                if not len(at):
                    continue
                piece, start = b.piece[at], b.place[at] + b.off[b.piece[at]]
                new = np.append(True, (piece[1:] != piece[:-1]) | (np.diff(start) > WIDTH))
                first = np.flatnonzero(new)
                spans = np.stack([start[first], start[np.append(first[1:], len(start)) - 1] + WIDTH], axis=1).astype("<i8")
                cut = common.starts_of(piece[first])
                own = piece[first[cut[:-1]]]
                runs = [spans[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b.did[own]), pa.array(b.th[own]), pa.array(runs, pa.binary())], schema=_RUNS)

    return run


# --- the whole


def _numbered(rows: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """Rows of a range to one task, sorted by range and batch."""
    return rows.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part", "bid").mapInArrow(run, schema)


def _answers(batches: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Batches with the answers of all ranges: an answer is a few bytes for each string that the batch sent."""
    one = replies.groupBy("bid").agg(F.collect_list(F.struct("part", "ranks")).alias(name))
    return batches.join(one, "bid", "left")


def pieces(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """What could repeat, as (bid, size, meta, data): about a megabyte of pieces a row. ids: did, th, own, each once."""
    buckets = max(16, -(-size // BUCKET))
    teams = 16 * math.isqrt(buckets)
    marks = docs.mapInArrow(_mark_batches(buckets, teams), "bucket int, docs binary, marks binary, counts binary, codes binary")
    parts = min(buckets, 50_000)
    marks = marks.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_mark_buckets(teams), "team int, docs binary, marks binary, counts binary")
    parts = min(teams, 50_000)
    marks = marks.repartitionById(parts, F.pmod("team", F.lit(parts))).sortWithinPartitions("team").mapInArrow(substrings.gathered("<i8"), "did long, th long, starts binary")
    heads = ids.groupBy("own").agg(F.min(F.struct("did", "th")).alias("x")).select("x.*")
    marks = common.durable(marks.join(heads, ["did", "th"], "left_semi"))
    common.release(docs.sparkSession)
    found = docs.join(marks, ["did", "th"]).select("did", "th", "text", "starts").mapInArrow(_cut_pieces, "key long, did long, th long, off long, piece binary")
    # pieces with a chosen substring in common lie together; a large group of them may be split
    found = found.hint("rebalance", max(2, common.partitions(docs)), "key").sortWithinPartitions("key", "did", "off").drop("key")
    return common.durable(found.mapInArrow(_gather_pieces, "bid long, size long, meta binary, data binary"))


def repeats(batches: DataFrame, size: int) -> DataFrame:
    """(did, th, starts): the intervals of each document that repeats of earlier documents cover, by pieces."""
    n, held = batches.agg(F.count("*"), F.sum("size")).first()
    batches = batches.drop("size")
    some = batches.where(F.pmod(F.xxhash64("bid"), F.lit(1 << 20)) < int(min(1.0, SAMPLED / max(1, n)) * (1 << 20)))
    cuts = [np.frombuffer(r[0], np.uint64) for r in some.mapInArrow(_cuts_of, "cuts binary").collect()]
    cuts = np.sort(np.concatenate([np.zeros(0, np.uint64), *cuts]))
    parts = max(16, min(50_000, (held or 0) // BATCH))
    ranges = np.unique(cuts[np.linspace(0, len(cuts) - 1, parts + 1).astype(int)[1:-1]] & _HEAD) if len(cuts) else cuts
    parts = len(ranges) + 1
    spark = batches.sparkSession
    sent = batches.mapInArrow(_send_triples(ranges), "part int, bid long, keys binary")
    names = common.durable(_numbered(sent, parts, _rank(_unpack_triples), "bid long, part int, ranks binary"))
    del sent
    common.release(spark)
    sent = _answers(batches, names, "names").select("bid", "meta", "data", "names").mapInArrow(_send_pairs, "part int, bid long, keys binary")
    pairs = common.durable(_numbered(sent, parts, _rank(_unpack_pairs), "bid long, part int, ranks binary"))
    del sent
    common.release(spark)
    both = _answers(_answers(batches, names, "names"), pairs, "pairs").select("bid", "meta", "data", "names", "pairs")
    sent = both.mapInArrow(_send_suffixes(ranges), "part int, bid long, keys binary")
    late = common.durable(_numbered(sent, parts, _merge, "bid long, part int, ranks binary"))
    del both, sent
    common.release(spark)
    return _answers(batches, late, "late").select("bid", "meta", "data", "late").mapInArrow(_repeats(ranges), "did long, th long, starts binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, texts, copies, all_found = batch.columns
            for doc_id, raw, copy, found in zip(ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist(), copies.to_pylist(), all_found.to_pylist(), strict=True):
                raw = raw or b""
                spans = sorted(tuple(x) for s in found or [] for x in np.frombuffer(s, "<i8").reshape(-1, 2).tolist())
                if copy and len(raw) >= WIDTH:
                    spans = [(0, len(raw))]
                kept, last, n = [], 0, 0
                for a, b in spans:
                    if a > last or not n:
                        kept.append(raw[last:a])
                        n += 1
                    last = max(last, b)
                out = b"".join([*kept, raw[last:]])
                rows.append((doc_id, len(raw), len(raw) - len(out), n, hashlib.sha256(out).hexdigest().encode() if digest else out))
            if rows:
                yield _pack(_OUT, rows)

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; with digest=True their SHA-256 in hex).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Strings are judged
    on the input; a document is never a repeat of itself. What stays may cut a character of several bytes in two.

    Null and empty texts have no bytes. Rows with a null doc_id come after all others and count as one document, as do
    rows that share a doc_id, which are versions of it; equal rows get equal results. An empty table gives no rows;
    other columns are ignored.
    """
    # texts are equal if 128 bits of their SHA-256 are (own); th tells apart the versions of one id only
    sha = F.sha2("text", 256)
    d = docs.select("doc_id", common.row_id().alias("did"), F.xxhash64(sha).alias("th"), F.unhex(F.substring(sha, 1, 32)).alias("own"), "text")
    ids = common.durable(d.groupBy("did", "th").agg(F.min("own").alias("own"), F.sum(F.octet_length("text")).alias("size")))  # the only scan for ids and sizes
    size = ids.agg(F.sum("size")).first()[0] or 0
    batches = pieces(d.select("did", "th", "text").where("text is not null"), ids.select("did", "th", "own"), size)
    common.release(docs.sparkSession)
    found = common.durable(repeats(batches, size).groupBy("did", "th").agg(F.collect_list("starts").alias("found")))
    del batches
    common.release(docs.sparkSession)
    heads = common.durable(ids.groupBy("own").agg(F.min("did").alias("head"), F.count("*").alias("n")).where("n > 1").select("own", "head"))
    # no aggregate stands between the shuffles and this join, so a text with many copies can be split
    copies = ids.select("did", "th", "own").join(heads, "own").where("did > head").select("did", "th")
    told = found.join(copies.withColumn("copy", F.lit(True)), ["did", "th"], "full")
    out = d.join(told, ["did", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "found")
    return out.mapInArrow(_remove(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes in all documents, with a digest of what stays; cases as in remove_repeats()."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
