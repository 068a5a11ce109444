"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the four base formats, obfuscated addresses, and every run of digit
groups, whole and in parts. Boosted trees score a proposal for each kind from its format and its context; a threshold
calibrated on held-out examples selects. Spans of the base formats always stay; a selected proposal joins them if it
overlaps none of them and no better proposal.

The trees learn from generated examples (seeded templates of real formats against look-alikes: prices, dates, versions,
order numbers), never from the corpus, so they behave alike at every size.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .boosting import Boosted, threshold

KINDS = ("email", "ip", "card", "phone")
#: Examples that are generated for training, their seed, and the precision that a kind's threshold must reach.
EXAMPLES, SEED, PRECISION = 6000, 17, 0.99

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: what matches from inside it matches from there too, and runs of any length
#: then take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[({] ?at ?[\])}] ?", re.I | re.A)
_HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]++)+", re.I | re.A)
_RUN = re.compile(r"[+(]?[0-9][0-9 ().-]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
#: A proposal of digits has up to so many groups and from so many to so many digits; hints are looked for in so many characters before.
GROUPS, DIGITS, CONTEXT = 6, (7, 19), 24
#: Proposals are made and scored in pieces of so many groups, and texts taken in batches of so many bytes.
PIECE, BATCH = 2048, 1 << 20
#: A piece ends where its groups lie so many characters apart; up to so many groups are taken one by one.
REACH, FEW = 1 << 16, 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def _local(text: str, at: int, end: int) -> int:
    """Where the run of characters of an address's local part begins that ends before at, not before end."""
    while at > end and (m := text[at - 1]).isascii() and (m.isalnum() or m in "._%+-"):
        at -= 1
    return at


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four formats by kind and start, leftmost and non-overlapping for each kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # the leftmost match at an @ takes the whole run of local characters before it
        low = _local(text, at, end)
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append(("email", low, end := m.end()))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int]]:
    """Spans that may hold personal data; they overlap."""
    return [span for starts, ends, _ in _proposed(text) for span in zip(starts.tolist(), ends.tolist(), strict=True)]


def _marked(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for mark in _AT.finditer(text):  # an address in words: the local part before the mark, the domain after it
        at = mark.start()
        at -= at > end and text[at - 1] == " "
        low = _local(text, at, end)
        m = _HIDDEN_DOMAIN.match(text, mark.end()) if low < at else None
        if m:
            yield low, (end := m.end())


def _proposed(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Proposals with their features in blocks of bounded size: starts, ends, a row of features each."""
    marks = _marked(text)
    while some := list(itertools.islice(marks, PIECE)):
        starts, ends = np.array(some).T
        yield starts, ends, np.array([features(text, s, e) for s, e in some], float)
    held: list[tuple[int, int, int, int]] = []
    number = 0
    for m in _RUN.finditer(text):
        number += 1
        first = m.start()  # what the run has before its first group belongs to proposals that begin there
        for g in _GROUP.finditer(text, *m.span()):
            a, b = g.span()
            if b - a > DIGITS[1]:  # no proposal reaches over it
                number += 1
            else:
                held.append((a, b, a - (a > 0 and text[a - 1] == "(") if first is None else first, number))
            first = None
            if len(held) > GROUPS and (len(held) == PIECE + GROUPS - 1 or b - held[0][0] > REACH):
                own = len(held) - GROUPS + 1  # the last ones may have neighbours yet to come
                yield from _grouped(text, held, own)
                held = held[own:]
    yield from _grouped(text, held, len(held))


def _grouped(text: str, groups: list[tuple[int, int, int, int]], own: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Proposals of up to six neighbouring groups (start, end, start of a proposal from here on, run) from each of the first own groups
    on, with the features that features() gives them one by one. Counts over a span are differences of running counts over the
    groups' surroundings."""
    if len(groups) <= FEW:  # arrays do not pay
        some = []
        for i in range(own):
            n = 0
            for a, b, _, run in groups[i : i + GROUPS]:
                n += b - a
                if run == groups[i][3] and DIGITS[0] <= n <= DIGITS[1]:
                    some.append((groups[i][2], b))
        if some:
            starts, ends = np.array(some).T
            yield starts, ends, np.array([features(text, s, e) for s, e in some], float)
        return
    a, b, first, run = np.array(groups).T
    size = b - a
    low = max(0, int(first[0]) - CONTEXT - 2)
    piece = text[low : int(b[-1]) + 2]
    code = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.int64)
    known, of = np.unique(code, return_inverse=True)
    kind = np.array([_near(chr(c)) for c in known])[of]
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    dots, dashes, spaces, opened = (count(code == ord(c)) for c in ".- (")
    hinted = count((kind == 2) | np.isin(code, [ord(c) for c in _HINTED]))
    digit = (code >= 48) & (code <= 57)
    place = count(digit)
    value = code[digit] - 48
    twice = np.where(value > 4, 2 * value - 9, 2 * value)
    even = np.arange(len(value)) % 2 == 0
    sums = np.stack([count(np.where(even, value, twice)), count(np.where(even, twice, value))])  # by the parity of the last digit's number
    back = lambda k: np.where(size > k, code[b - low - 1 - k] - 48, 0)
    octet = (size <= 3) & (back(0) + 10 * back(1) + 100 * back(2) <= 255)
    areas = np.array([m.span() for m in _AREA.finditer(piece)]).reshape(-1, 2)
    hints: dict[int, list[bool]] = {}
    starts, ends, rows = [], [], []
    for k in range(GROUPS):
        i = np.arange(min(own, len(a) - k))
        if not len(i):
            break
        sizes = np.stack([size[i + j] for j in range(k + 1)])
        n = sizes.sum(0)
        fit = (n >= DIGITS[0]) & (n <= DIGITS[1]) & (run[i] == run[i + k])
        if not fit.any():
            continue
        i, n, sizes = i[fit], n[fit], sizes[:, fit]
        s, e = first[i], b[i + k]
        x, y = s - low, e - low
        over = lambda c: c[y] - c[x]  # noqa: B023, E731
        p, q = place[x], place[y]
        parity = (q - 1) % 2
        checked = (n >= 13) & ((sums[parity, q] - sums[parity, p]) % 10 == 0)
        quads = (k == 3) & (over(dots) == 3) & np.all([octet[i + j] for j in range(k + 1)], axis=0)
        before, after = np.where(x > 0, kind[x - 1], 0), np.where(y < len(code), kind[np.minimum(y, len(code) - 1)], 0)
        left, right = np.where(x > 0, code[x - 1], 0), np.where(y < len(code), code[np.minimum(y, len(code) - 1)], 0)
        at = np.searchsorted(areas[:, 0], x) if len(areas) else np.zeros(len(x), np.int64)
        area = (at < len(areas)) & (np.append(areas[:, 1], 0)[np.minimum(at, len(areas))] <= y) if len(areas) else np.zeros(len(x), bool)
        row = np.zeros((len(x), FEATURES))
        row[:, :20] = np.stack([
            n, np.full(len(x), k + 1), sizes[0], sizes[-1], sizes.max(0), sizes.min(0), e - s, code[x] == ord("+"), over(opened) > 0, over(dots), over(dashes), over(spaces),
            checked, quads, np.zeros(len(x)), before, after, np.isin(left, [ord(c) for c in "$€£#"]), np.isin(right, [ord(c) for c in "%€$"]), area,
        ], 1)
        for j in np.flatnonzero(hinted[x] > hinted[np.maximum(x - CONTEXT, 0)]):
            if s[j] not in hints:
                hints[s[j]] = _hints(text[max(0, s[j] - CONTEXT) : s[j]])
            row[j, 20:] = hints[s[j]]
        starts.append(s), ends.append(e), rows.append(row)
    if rows:
        yield np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)


_HINTS = {k: re.compile(v, re.I) for k, v in {
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp|móvil|tél|anruf|handy",
    "card": r"card|visa|credit|debit|amex|tarjeta|carte|karte|pay",
    "ip": r"\bip\b|host|server|address|client",
    "email": r"mail|contact|write|@",
    "other": r"order|invoice|isbn|version|price|total|no\.|#|id\b|ref|page|\$|€|build",
}.items()}
FEATURES = 25
#: What is not a letter and yet may hint.
_HINTED = "@#$€"
_AREA = re.compile(r"\(\d{2,4}\)")


def _hints(before: str) -> list[bool]:
    return [bool(p.search(before)) for p in _HINTS.values()]


def _near(c: str) -> int:
    return 0 if not c else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c.isspace() else 4


def features(text: str, s: int, e: int) -> list[float]:
    """Format of the span and what stands around it."""
    x = text[s:e]
    before, after = text[max(0, s - CONTEXT) : s], text[e : e + 1]
    groups = _GROUP.findall(x)
    d = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    quads = len(groups) == 4 and x.count(".") == 3 and all(n <= 3 and int(g) <= 255 for n, g in zip(sizes, groups, strict=True))
    return [
        len(d), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), len(x), x.startswith("+"), "(" in x, x.count("."), x.count("-"), x.count(" "),
        13 <= len(d) <= 19 and luhn(d), quads, sum(c.isalpha() for c in x), _near(before[-1:]), _near(after[:1]),
        before[-1:] in "$€£#" and before != "", after[:1] in "%€$" and after != "", bool(_AREA.search(x)),
        *_hints(before),
    ]


def _example(r: random.Random) -> tuple[str, int, int, str]:
    """A text with one span and its kind ('' for a look-alike)."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeiourstnlmdch") for _ in range(r.randint(2, 8)))

    def card() -> str:
        k = r.choice((13, 15, 16, 16, 16, 19))
        d = r.choice("3456") + n(k - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def cut(d: str, sep: str, size: int = 4) -> str:
        return sep.join(d[i : i + size] for i in range(0, len(d), size))

    kind = r.choice(("email", "ip", "card", "phone", "", "", "", ""))
    if kind == "email":
        at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("{at}", ".")))
        x = f"{w()}{r.choice(('', '.', '_'))}{w()}{at}{w()}{dot}{r.choice(('com', 'org', 'net', 'de', 'io'))}"
    elif kind == "ip":
        x = ".".join(str(r.randint(1, 255)) for _ in range(4))
    elif kind == "card":
        x = cut(card(), r.choice(("", "", " ", "-")))
    elif kind == "phone":
        x = r.choice((f"({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)} {n(4)}", f"+{r.randint(1, 99)} {n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{n(11)}", f"0{n(2)} {n(4)} {n(4)}"))
    else:
        x = r.choice((
            f"{r.randint(1, 99)}.{r.randint(0, 30)}.{r.randint(0, 40)}", f"20{n(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{n(7)}", f"{n(16)}", f"{n(16)}", cut(n(16), " "), f"{n(8)}.{n(2)}", f"{n(10)}", f"{n(12)}",
            f"{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"{n(4)} {n(4)}", f"{n(2)}-{n(5)}-{n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.19{n(2)}", f"{n(2)} {n(2)} {n(3)} {n(2)}", cut(n(14), "-", 7),
        ))
        digits = _digits(x)
        if 13 <= len(digits) <= 19 and luhn(digits):
            x = x[:-1] + str((int(x[-1]) + 1) % 10)
    hint = {"phone": ("call ", "tel: ", "phone ", "mobile "), "card": ("card ", "visa ", "paid by card "), "ip": ("ip ", "host ", "from "), "email": ("mail ", "contact ", "write to "), "": ("order ", "invoice ", "version ", "total $", "no. ", "page ", "build ", "id ")}[kind]
    before = f"{w()} {w()} " + (r.choice(hint) if r.random() < 0.4 else "")
    after = r.choice((" ", ". ", ", ", "\n")) + w()
    return before + x + after, len(before), len(before) + len(x), kind


@functools.lru_cache(maxsize=2)
def model(examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> dict[str, tuple[Boosted, float]]:
    """Trees and threshold of each kind; a fifth of the examples is held out for the threshold."""
    r = random.Random(seed)
    made = [_example(r) for _ in range(examples)]
    x = np.array([features(t, s, e) for t, s, e, _ in made], float)
    kinds = np.array([k for *_, k in made])
    held = np.arange(examples) % 5 == 0
    out = {}
    for k in KINDS:
        b = Boosted().fit(x[~held], (kinds[~held] == k).astype(float))
        out[k] = (b, max(0.5, threshold(b.probability(x[held]), kinds[held] == k, precision)))
    return out


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _chosen(x: np.ndarray, trees: dict[str, tuple[Boosted, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of features those that pass a threshold: their numbers, scores and kinds. Equal rows are scored once."""
    rows = np.ascontiguousarray(x)
    _, some, of = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    scores = np.stack([trees[k][0].probability(x[some]) for k in KINDS], 1)
    over = scores - np.array([trees[k][1] for k in KINDS])
    best = over.argmax(1)
    good = np.flatnonzero((over.max(1) >= 0)[of])
    return good, scores[np.arange(len(some)), best][of[good]], best[of[good]]


def _added(text: str, sure: list[tuple[str, int, int]], trees: dict[str, tuple[Boosted, float]]) -> list[tuple[str, int, int]]:
    """The best proposals that overlap neither a base span nor a better one. Only proposals that pass are kept."""
    taken = bytearray(len(text))  # which characters base spans cover
    for _, s, e in sure:
        taken[s:e] = b"\1" * (e - s)
    held = []
    for starts, ends, x in _proposed(text):
        if sure:
            free = np.array([taken.find(1, s, e) < 0 for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], bool)
            starts, ends, x = starts[free], ends[free], x[free]
        if len(x):
            good, score, kind = _chosen(x, trees)
            held.append(np.stack([score, starts[good], ends[good], kind], 1))
    out = []
    if held:
        score, start, end, kind = np.concatenate(held).T
        for j in np.lexsort((end, start, start - end, -score)):
            s, e = int(start[j]), int(end[j])
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                out.append((KINDS[int(kind[j])], s, e))
    return out


def detect(texts: list[str], trees: dict[str, tuple[Boosted, float]]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, sorted by kind and start."""
    out = []
    for t in texts:
        sure = base(t)
        out.append((_order(sure), _order(sure + _added(t, sure, trees))))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _run(trees, replace: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, "text", BATCH):
            texts = batch.column(1).to_pylist()
            found = detect([t or "" for t in texts], trees)
            of = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            columns = [batch.column(0).cast(pa.int64()).combine_chunks(), pa.array([of(b) for b, _ in found], _SPAN), pa.array([of(a) for _, a in found], _SPAN)]
            names = ["doc_id", "base", "spans"]
            if replace:
                columns.append(pa.array([None if t is None else redact(t, a) for t, (_, a) in zip(texts, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


def find_pii(docs: DataFrame, replace: bool = True, **settings) -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end in code points, end exclusive) and redacted, the text without them.

    A null text counts as empty and stays null in redacted. Rows are judged one by one: repeated rows give equal
    results, a null doc_id is passed on, an empty table gives no rows, other columns are ignored.
    """
    trees = model(**settings)
    schema = f"doc_id long, base {_SPANS}, spans {_SPANS}" + ", redacted string" * replace
    return docs.select("doc_id", "text").mapInArrow(_run(trees, replace), schema)


def _redact_all(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.by_bytes(batches, "text", BATCH):
            batch = whole.combine_chunks().to_batches()[0]
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = detect([t or "" for t in texts], trees)
            new = pa.array([None if t is None else redact(t, a) for t, (_, a) in zip(texts, found, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return run


def redacted(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span in text replaced; all other columns as they were. A null text stays null, an empty one empty;
    repeated rows and rows with a null doc_id are redacted like others; an empty table gives an empty one."""
    return docs.mapInArrow(_redact_all(model(**settings)), docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, b, a = (c.to_pylist() for c in batch.columns)
        say = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        counts = [pa.array([sum(s["kind"] == k for s in x) for x in b], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_id, pa.int64()), *counts, pa.array([hashlib.sha256(say(x).encode()).hexdigest() for x in b]), pa.array([say(x) for x in a])],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
        )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents with a digest of the base ones; cases as in find_pii()."""
    found = find_pii(common.table(spark, sf_dir, "documents"), replace=False)
    return found.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
