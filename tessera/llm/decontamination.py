"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. A distributed randomised SVD of the TF-IDF passages of all documents gives a latent space: tasks multiply their
   passages with a random matrix and back (the range of the matrix), then with the basis of that range; only sums travel.
   Passages of the benchmark weigh ten times those of the corpus, so that the space tells items apart rather than common
   words. Only words of items count in a search, so the space is that of their columns.
   A passage's vector counts each word once, so its length is that of its distinct words.
3. Every passage of every document is compared, as a latent vector, with the passages of all benchmark items; pairs of a
   high cosine are candidates. The cosine divides by the passage's whole TF-IDF length: what the space cannot show of a
   passage speaks against it. Only words of items count above the line, and a passage scores no more with any item than
   its words' best scores together: passages that this sum keeps below the limit, nearly all, are settled without loss.
   A space of fixed rank shows less of an item the more items it serves, so each block of items has a space of its own;
   tasks read and split a text once for as many blocks as they are sent, to learn as to search.
4. Runs of words that a document shares with an item, found by rolling hashes, are candidates whatever their cosine:
   an item that is held unchanged is never lost. Items too short for a passage are looked up whole.
5. A candidate is a leak if the longest common subsequence of the item's words and those around the passage covers
   enough of the item, and enough of its answer where one is marked, so that paraphrases count and shared vocabulary
   does not; or if it shares a long run of words with the item, whatever it lacks of the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens, totals

#: Bits of the word hash that name a feature; rank of the latent space, and what the range finder takes beyond it.
BITS, RANK, OVER, SEED = 16, 128, 8, 11
#: Words of a passage from which the space is learned.
FIT_WORDS = 32
#: How much more than the corpus's the benchmark's passages weigh together.
ITEMS_WEIGH = 10.0
#: Passage lengths in words; an item is searched with the longest that it fills. Passages overlap by half.
SCALES = (8, 16, 32, 64)
#: Items below this many words leak where they stand whole and unchanged; paraphrases of them are no evidence.
LEAST_WORDS = 6
#: Cosine of a candidate; shares of the item's and of its marked answer's words that a leak has in order; words of an
#: item that are a leak by themselves where they stand unchanged and together.
COSINE, COVER, ANSWER, RUN_WORDS = 0.25, 0.6, 0.5, 13
#: Items that share a latent space and are sent to the tasks at once: two to a dimension, so that a space of RANK shows
#: some two thirds of the length of unrelated items. A larger benchmark is searched in blocks of this size.
BLOCK = 2 * RANK
#: Blocks that a pass over the documents learns or searches for; each takes a few megabytes in a task.
AT_ONCE = 16
#: Words of a shared run that makes a candidate by itself, at most those of the shortest item; factor of the rolling hash.
SEED_WORDS, FACTOR = LEAST_WORDS, np.uint64(0x9E3779B97F4A7C15)
#: Stand for the cosine of a candidate that only a shared run made, and for the answer's share where none is marked.
NO_COSINE = NO_ANSWER = -1.0
#: Bits of a run's hash that are looked up before the hash itself.
SIEVE = 18
BATCH = 1 << 20


def features(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - BITS)).astype(np.uint16)


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    _, _, code, first = tokens.words(*tokens.buffer(texts), plain=True)
    return code, first


def previous(f: np.ndarray) -> np.ndarray:
    """Where each word's feature occurred last before it, -1 if nowhere."""
    order = np.argsort(f, kind="stable").astype(np.int32)  # numbers of 16 bits are sorted by their digits
    out = np.full(len(f), -1, np.int32)
    again = f[order[1:]] == f[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


def _frequency(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """Documents with each feature; documents; passages from which a space is learned."""
    out = None
    for t in common.by_bytes(batches, "text", BATCH):
        out = np.zeros((1 << BITS) + 2) if out is None else out
        code, first = _words(t["text"])
        f = features(code)
        new = previous(f) < np.repeat(first[:-1], np.diff(first))
        out[: 1 << BITS] += np.bincount(f[new], minlength=1 << BITS)
        out[-2:] += t.num_rows, len(blocks(first, FIT_WORDS)[0])
    return out


def blocks(first: np.ndarray, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of hop words begin in texts that begin at first (with the end), and the text of each."""
    n = -(-np.diff(first) // hop)
    doc = np.repeat(np.arange(len(n)), n)
    return first[:-1][doc] + hop * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), doc


def distinct_passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages from which the space is learned, each once a passage, and where each passage begins."""
    code, first = _words(texts)
    f = features(code)
    start, _ = blocks(first, FIT_WORDS)
    size = np.diff(np.append(start, len(f)))
    new = previous(f) < np.repeat(start, size)
    return f[new], np.concatenate([[0], np.cumsum(new)])[start].astype(np.int64) if len(start) else start


def _sums(rows: np.ndarray, of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of rows[of] over blocks of words; some blocks at a time, so that long texts need no more memory."""
    out = np.zeros((len(start), rows.shape[1]), np.float32)
    end = np.append(start[1:], len(of))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2048, side="right")))
        out[at:to] = np.add.reduceat(rows[of[start[at] : end[to - 1]]], start[at:to] - start[at])
        at = to
    return out


def omega(n: int, k: int) -> np.ndarray:
    """The random matrix of the range finder; tasks make it rather than receive it."""
    return np.random.default_rng(SEED).standard_normal((n, k), np.float32)


def _fit(batches: Iterator[pa.RecordBatch], idf: np.ndarray, known: list[np.ndarray], k: int, bases: list[np.ndarray] | None = None) -> np.ndarray | None:
    """For each space, one after the other, sums of A'(A omega), or of (A basis)'(A basis) where bases are given, over passages:
    A has a row of TF-IDF for each, divided by its whole length, and the columns of the features that the space knows."""
    out = None
    for t in common.by_bytes(batches, "text", BATCH):
        f, start = distinct_passages(t["text"])
        if out is None:
            place = np.full((len(known), 1 << BITS), -1, np.int32)
            for p, own in zip(place, known, strict=True):
                p[own] = np.arange(len(own))
            right = [(omega(len(own), k) if bases is None else bases[i]) * idf[own, None] for i, own in enumerate(known)]
            out = [np.zeros((len(own), k), np.float32) if bases is None else np.zeros((k, k)) for own in known]
        if not len(start):
            continue
        norm = np.sqrt(np.maximum(np.add.reduceat(idf[f] ** 2, start), 1e-12)).astype(np.float32)
        passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(f))))
        for p, own, x, y in zip(place, known, right, out, strict=True):
            row = p[f]
            at = np.flatnonzero(row >= 0)
            if not len(at):
                continue
            row, cut = row[at], common.starts_of(passage[at])
            length = norm[passage[at[cut[:-1]]], None]
            z = _sums(x, row, cut[:-1]) / length
            if bases is not None:
                y += z.T.astype(float) @ z
                continue
            z /= length
            order = np.argsort(row, kind="stable")
            of = np.repeat(np.arange(len(z)), np.diff(cut))[order]
            cut = common.starts_of(row[order])
            which = row[order[cut[:-1]]]
            y[which] += idf[own[which], None] * _sums(z, of, cut[:-1])
    return None if out is None else np.concatenate([y.ravel() for y in out])


def orthonormal(y: np.ndarray) -> np.ndarray:
    """A basis of the columns' span, by the Gram matrix, in the place of y; directions of no weight become zero columns."""
    g = sum(y[a : a + 8192].T.astype(float) @ y[a : a + 8192] for a in range(0, len(y), 8192))
    w, u = np.linalg.eigh(g)
    turn = np.where(w > 1e-9 * w.max(), u / np.sqrt(np.maximum(w, 1e-30)), 0).astype(np.float32)
    for a in range(0, len(y), 8192):
        y[a : a + 8192] = y[a : a + 8192] @ turn
    return y


def latent_spaces(docs: DataFrame, of: list[tuple[pa.Array, np.ndarray]], idf: np.ndarray, n_passages: float, rank: int = RANK) -> list[np.ndarray]:
    """For each block of items, its texts and the features that its space knows, a row a feature: its weighted place in the
    space, the leading right singular vectors of the passages of all docs and of the block, a row times its idf.

    Two passes over docs, of which n_passages is the number of passages, serve all blocks.
    """
    sc = docs.sparkSession.sparkContext
    k, known = rank + OVER, [f for _, f in of]
    own = [[pa.RecordBatch.from_arrays([x], ["text"])] for x, _ in of]
    weigh = [ITEMS_WEIGH * max(1.0, n_passages) / max(1, len(blocks(_words(x)[1], FIT_WORDS)[0])) for x, _ in of]

    def sums(bases: list[np.ndarray] | None, rows: list[int], kind) -> list[np.ndarray]:
        edge = np.cumsum([0, *(n * k for n in rows)])
        shared = sc.broadcast((idf, known, k, bases))
        total = totals.total(docs, lambda batches: _fit(batches, *shared.value), int(edge[-1]), kind)
        shared.destroy()
        out = [total[a:b].reshape(-1, k) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for i, y in enumerate(out):
            x = _fit(iter(own[i]), idf, [known[i]], k, None if bases is None else [bases[i]])
            if x is not None:
                y += kind(weigh[i]) * x.reshape(-1, k).astype(kind)
        return out

    bases = [orthonormal(y) for y in sums(None, [len(f) for f in known], np.float32)]
    grams = sums(bases, [k] * len(known), np.float64)
    out = []
    for f, basis, g in zip(known, bases, grams, strict=True):
        turn = np.linalg.eigh(g)[1][:, ::-1][:, :rank].astype(np.float32)
        out.append(basis @ turn * idf[f, None])
    return out


def latent_space(docs: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The one space of all features, for items that are few."""
    n = totals.total(docs, _frequency, (1 << BITS) + 2)[-1]
    texts = pa.array([r["text"] for r in items.select("text").collect()], pa.string())
    return latent_spaces(docs, [(texts, np.arange(1 << BITS))], idf, n, rank)[0]


def known_features(texts: pa.Array) -> np.ndarray:
    """Features of the items that are long enough for passages."""
    code, first = _words(texts)
    n = np.diff(first)
    return np.unique(features(code[np.repeat(n >= LEAST_WORDS, n)]))


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: int | None  # its answer begins at this word; None if no answer is marked
    places: dict[int, int]  # bits of the places of each word


def answer_start(text: str, count) -> int | None:
    """The word at which the answer begins: after the last answer mark, else the last question mark, else None."""
    marks = list(re.finditer(r"(?i)\b(?:answer|solution|a)\s*[:=]", text)) or list(re.finditer(r"\?", text))
    at = count(text[: marks[-1].end()]) if marks else 0
    return at if marks and at < count(text) else None


@dataclass
class Space:
    """A block of items and what a task needs to search for them."""

    items: list[Item]
    place: np.ndarray  # of each feature its row, -1 for words of no item
    rows: np.ndarray  # weighted places of the features of items
    probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by scale: unit vectors, item numbers, first words
    best: dict[int, np.ndarray]  # by scale: what each row adds to a score at most
    seeds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    short: dict[int, dict[bytes, list[int]]]  # by length: words of items too short for passages


def space_of(rows: list[tuple[int, str]], latent: np.ndarray | None) -> Space:
    """Items with the latent unit vectors of their passages; latent may be None if all items are short."""
    code, first = _words(pa.array([t for _, t in rows], pa.string()))
    items: list[Item] = []
    found: dict[int, list] = {}
    short: dict[int, dict[bytes, list[int]]] = {}
    for (item_id, text), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if not n:
            continue
        words = code[a:b].tolist()
        places: dict[int, int] = {}
        for i, w in enumerate(words):
            places[w] = places.get(w, 0) | 1 << i
        count = lambda t: len(_words(pa.array([t]))[0])
        items.append(Item(item_id, words, answer_start(text, count), places))
        if n < LEAST_WORDS:
            short.setdefault(n, {}).setdefault(code[a:b].tobytes(), []).append(len(items) - 1)
            continue
        scale = max([s for s in SCALES if s <= n], default=SCALES[0])
        for s in sorted({*range(0, max(1, n - scale + 1), scale // 2), max(0, n - scale)}):
            found.setdefault(scale, []).append((latent[np.unique(features(code[a + s : min(b, a + s + scale)]))].sum(0), len(items) - 1, s))
    probes = {}
    for scale, of in found.items():
        v, i, s = zip(*of, strict=True)
        v = np.stack(v)
        probes[scale] = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), np.array(i), np.array(s))
    long = [i for i, x in enumerate(items) if len(x.words) >= LEAST_WORDS]
    known = np.unique(features(np.array([w for i in long for w in items[i].words], np.uint64)))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    own = latent[known] if long else np.zeros((0, RANK), np.float32)
    best = {scale: (own @ v.T).max(1).astype(np.float64) for scale, (v, _, _) in probes.items()}
    return Space(items, place, own, probes, best, seeds_of(items, long) if long else None, short)


def runs_of(code: np.ndarray) -> np.ndarray:
    """A hash of the SEED_WORDS words from each word on; the last words have none."""
    n = len(code) - SEED_WORDS + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for i in range(SEED_WORDS):
            out = out * FACTOR + code[i : i + n]
    return out


def seeds_of(items: list[Item], long: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which leading bits of hashes occur; the sorted hashes of all runs of items, their item numbers and first words."""
    runs = [runs_of(np.array(items[i].words, np.uint64)) for i in long]
    h, which = np.concatenate(runs), np.repeat(np.array(long), [len(r) for r in runs])
    begin = np.concatenate([np.arange(len(r)) for r in runs])
    order = np.argsort(h, kind="stable")
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[h >> np.uint64(64 - SIEVE)] = True
    return sieve, h[order], which[order], begin[order]


def shared_runs(h: np.ndarray, first: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item number, first word in the batch, first word in the item, words) of every longest shared run."""
    sieve, known, which, begin = seeds
    at = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE)])
    doc = np.searchsorted(first, at, side="right") - 1
    inside = at + SEED_WORDS <= first[doc + 1]
    at, doc = at[inside], doc[inside]
    low = np.searchsorted(known, h[at], side="left")
    many = np.searchsorted(known, h[at], side="right") - low
    n = int(many.sum())
    seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(n)
    at, doc, item, place = np.repeat(at, many), np.repeat(doc, many), which[seed], begin[seed]
    order = np.lexsort((at, at - place, item, doc))
    at, doc, item, place = at[order], doc[order], item[order], place[order]
    cut = common.starts_of(doc, item, at - place, at - np.arange(n))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(doc[a]), int(item[a]), int(at[a]), int(place[a]), b - a + SEED_WORDS - 1


def short_items(code: np.ndarray, first: np.ndarray, short: dict[int, dict[bytes, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(text, item number, first word in the batch) of the short items that stand whole in a text."""
    for n, of in short.items():
        heads = np.array(sorted({np.frombuffer(k, np.uint64)[0] for k in of}), np.uint64)
        at = np.flatnonzero(np.isin(code, heads))
        doc = np.searchsorted(first, at, side="right") - 1
        for a, d in zip(at.tolist(), doc.tolist(), strict=True):
            for i in of.get(code[a : a + n].tobytes(), ()) if a + n <= first[d + 1] else ():
                yield d, i, a


def common_words(item: Item, words: list[int], least: float = COVER) -> tuple[float, float | None]:
    """Shares of the item's words, and of its answer's (None without a marked answer), in a longest common subsequence
    with words; bit-parallel. Zeros if the first share is surely below least."""
    n = len(item.words)
    seen = [m for m in map(item.places.get, words) if m]
    if len(seen) < least * n:
        return 0.0, 0.0
    full = (1 << n) - 1

    def length(mask: int) -> int:
        s = full
        for m in seen:
            u = s & m & mask
            s = ((s + u) | (s - u)) & full
        return n - s.bit_count()

    if item.answer is None:
        return length(full) / n, None
    return length(full) / n, length(full >> item.answer << item.answer) / (n - item.answer)


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("cover", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())])


class Passages:
    """The passages of a scale in a batch of texts: half-overlapping spans, each word of a span counted once.

    A passage is two hops of half a scale; a text of one hop is a passage too. A word counts in its passage if it did not
    occur in it before, so sums over passages are sums over hops by two rules: from the hop's own start, and from that of
    the hop before it.
    """

    def __init__(self, first: np.ndarray, before: np.ndarray, scale: int):
        self.hops, doc = blocks(first, scale // 2)
        n = len(self.hops)
        self.of = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(self.hops, len(before))))
        same = np.append(doc[1:] == doc[:-1], False)  # the next hop is of the same text
        self.pairs = np.flatnonzero(same)
        self.alone = np.flatnonzero(~same & ~np.append(False, same[:-1]))
        low = np.where(np.append(False, same[:-1]), np.append(0, self.hops[:-1]), len(before))
        self.opens, self.goes_on = before < self.hops[self.of], before < low[self.of]
        self.start = np.concatenate([self.hops[self.pairs], self.hops[self.alone]])
        self.doc = np.concatenate([doc[self.pairs], doc[self.alone]])
        self.end = np.minimum(self.start + scale, first[self.doc + 1])

    def sums(self, of_word: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Sums over each passage of a number that each of the words at some places has."""
        n, of = len(self.hops), self.of[at]
        a = np.bincount(of, of_word * self.opens[at], n)
        b = np.bincount(of, of_word * self.goes_on[at], n)
        return np.concatenate([a[self.pairs] + b[self.pairs + 1], a[self.alone]])


def _latent(space: Space, at: np.ndarray, row: np.ndarray, before: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Latent vectors of spans, of the known words: at are their places, row their rows, before as in Passages."""
    out = np.zeros((len(start), space.rows.shape[1]), np.float32)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    for a in range(0, len(start), 512):
        n = (hi - lo)[a : a + 512]
        turn = np.repeat(lo[a : a + 512] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.repeat(np.arange(len(n)), n)
        new = before[turn] < start[a : a + 512][own]
        turn, own = turn[new], own[new]
        if len(own):
            cut = common.starts_of(own)[:-1]
            out[a + own[cut]] = np.add.reduceat(space.rows[row[turn]], cut)
    return out


def _candidates(spaces: list[Space], idf: np.ndarray, code: np.ndarray, first: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, int, int, float, int]]:
    """(text, space, item number, first word where the item would begin, slack, cosine, words of the shared run)."""
    f = features(code)
    before = previous(f)
    squares = idf[f].astype(np.float64) ** 2
    each = []
    for space in spaces:
        row = space.place[f]
        at = np.flatnonzero(row >= 0)
        each.append((at, row[at], before[at]))
    for scale in sorted({s for space in spaces for s in space.probes}):
        passages = Passages(first, before, scale)
        length = np.sqrt(passages.sums(squares))
        for k, (space, (at, row, last)) in enumerate(zip(spaces, each, strict=True)):
            if scale not in space.probes or not len(at):
                continue
            v, which, begin = space.probes[scale]
            most = passages.sums(space.best[scale][row], at)
            keep = np.flatnonzero((most >= (cosine - 1e-4) * length) & (length > 0))  # room for rounding
            for a in range(0, len(keep), 8192):
                own = keep[a : a + 8192]
                z = _latent(space, at, row, last, passages.start[own], passages.end[own]) / length[own, None].astype(np.float32)
                score = z @ v.T
                for p, q in np.argwhere(score >= cosine).tolist():
                    yield int(passages.doc[own[p]]), k, int(which[q]), int(passages.start[own[p]]) - int(begin[q]), scale // 2, float(score[p, q]), 0
    if any(space.seeds for space in spaces):
        h = runs_of(code)
        for k, space in enumerate(spaces):
            for d, i, at, place, n in shared_runs(h, first, space.seeds) if space.seeds else ():
                yield d, k, i, at - place, SCALES[0] // 2, NO_COSINE, n
    for k, space in enumerate(spaces):
        for d, i, at in short_items(code, first, space.short):
            yield d, k, i, at, 0, NO_COSINE, len(space.items[i].words)


def _judged(space: Space, i: int, found: list[tuple], code: np.ndarray, first: int, end: int) -> tuple | None:
    """(cover, answer, cosine, first word) of an item's best candidate in a text that is a leak, best cosine first."""
    item = space.items[i]
    n = len(item.words)
    best, seen = None, set()
    score = max(c[5] for c in found)
    for _, _, _, low, slack, _, run in sorted(found, key=lambda c: (-c[6], -c[5], c[3])):
        slack = max(slack, n // 4) if n >= LEAST_WORDS else 0
        lo, hi = max(first, low - slack), min(end, low + n + slack)
        sure = run >= min(RUN_WORDS, n)
        if (lo, hi) in seen:
            continue
        seen.add((lo, hi))
        cover, answer = common_words(item, code[lo:hi].tolist(), 0.0 if sure else COVER)
        if sure or (cover >= COVER and (answer is None or answer >= ANSWER)):
            row = (cover, NO_ANSWER if answer is None else answer, score, first - lo)
            best = row if best is None else max(best, row)
            if cover == 1.0:
                break
    return best


def _search(shared, probing, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, spaces = shared.value, probing.value
        for t in common.by_bytes(batches, "text", BATCH):
            code, first = _words(t["text"])
            if not len(code):
                continue
            found: dict[tuple[int, int, int], list] = {}
            for c in _candidates(spaces, idf, code, first, cosine):
                found.setdefault(c[:3], []).append(c)
            ids, rows = t["doc_id"], []
            for (d, k, i), of in found.items():
                best = _judged(spaces[k], i, of, code, int(first[d]), int(first[d + 1]))
                if best:
                    cover, answer, score, place = best
                    rows.append((ids[d].as_py(), spaces[k].items[i].item_id, None if score == NO_COSINE else score, cover, None if answer == NO_ANSWER else answer, -place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per leak: doc_id, item_id, cosine, cover, answer (shares of words found in order), first_word.

    cosine is null where only a shared run of words led to the item, answer where the item marks none.
    Words are runs of letters and digits, A-Z as a-z. Null and empty texts, in documents or items, leak nothing, nor do
    items with a null item_id; items below six words leak only where they stand whole; equal items are reported each. A null doc_id is passed on, repeated
    rows are reported each; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    counts = totals.total(d, _frequency, (1 << BITS) + 2)
    idf = (np.log((2 + counts[-2]) / (1 + counts[: 1 << BITS])) ** 2).astype(np.float32)  # squared: rare words tell passages apart
    hits = "doc_id long, item_id long, cosine double, cover double, answer double, first_word long"
    out = None
    shared = spark.sparkContext.broadcast(idf)
    turns = -(-wanted.count() // BLOCK)
    for low in range(0, turns, AT_ONCE):
        parts = []
        for block in range(low, min(turns, low + AT_ONCE)):
            part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == block) if turns > 1 else wanted
            rows = sorted((r["item_id"], r["text"]) for r in part.collect())
            texts = pa.array([t for _, t in rows], pa.string())
            parts.append((rows, texts, known_features(texts)))
        of = [(texts, known) for _, texts, known in parts if len(known)]
        learned = iter(latent_spaces(d, of, idf, counts[-1]) if of else ())
        spaces = []
        for rows, _, known in parts:
            latent = np.zeros((1 << BITS, RANK), np.float32) if len(known) else None
            if len(known):
                latent[known] = next(learned)
            spaces.append(space_of(rows, latent))
        spaces = [x for x in spaces if x.items]
        if spaces:
            found = d.mapInArrow(_search(shared, spark.sparkContext.broadcast(spaces), cosine), hits)
            found = common.durable(found) if turns > AT_ONCE else found  # a pass, and what it was sent, ends here
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], hits) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item; rows with a null doc_id stay only if no such row leaks, as do rows that
    share an id. Null and empty texts stay; all columns stay as they are; empty tables give what they hold."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_leaks"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items in all documents; cases as in leaks()."""
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
