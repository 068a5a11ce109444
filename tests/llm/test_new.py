"""License scans, vector codes and manifests against plain Python, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with those used inside."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import codes, licenses, manifest, queries

LONG = 300_000


def _documents():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    own = lambda n: " ".join(word() for _ in range(n))
    mit = dict((len(t), t) for x, t in licenses.TEMPLATES if x == "mit")
    notice = mit[max(mit)]
    off = notice.split()
    off[7], off[15] = "other", "words here"
    texts = [None, "", " \t\n--", "All Rights Reserved. all rights  reserved", "cc-by cc by-nc 4.0, CC_BY", own(40), own(30) + " " + notice + " " + own(9), own(5) + " ".join(off), " ".join(notice.split()[:12]),
             "the GNU General Public License, version 3.", "general public licenseall rights reserved", "cc", "all rights", "KK ccK by", "cc by " * 500, own(20) + " " + "z" * LONG + " cc by", own(60_000) + " all rights reserved",
             "Licensed under the Apache License, Version 2.0", "\0cc\0by\0", "ÀLL RIGHTS RESERVED all rights reserved"]
    rows = [(i + 1, t, "abc"[i % 3] if i % 4 else None) for i, t in enumerate(texts)]
    more = [(1000 + i, own(r.randint(0, 9)) + r.choice(["", " cc by", " ABC"]), "big") for i in range(700)]
    return rows + more + [rows[3], rows[3], (None, "all rights reserved", None), (None, "cc by", "lone"), (None, "cc by", "lone"), (4, "another text", "a"), (7777, "only one", "single")]


DOCS = _documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("new"))
    made = [(i, t, "de" if i else None, s, None if i == 5 else len(t or ""), "x", 7, 7, "x", 1, 2, "y", "z") for i, t, s in DOCS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, did long, place long, leaf string, tree long, size long, path string, label string"
    spark.createDataFrame(made, schema).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int, vector string, code string, error long, part int").repartition(4).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_licenses_brute_force(spark, folder):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def found(w):
        """Spans by merging equal grams' diagonals, straight from the definition."""
        places, base, labels, best = [], set(), set(), 0.0
        for phrase, (label, t) in [(True, x) for x in licenses.PHRASES] + [(False, x) for x in licenses.TEMPLATES]:
            t = cut(t)
            n, k = len(t), min(licenses.K, len(t))
            at = {}
            for q in range(n - k + 1):
                at.setdefault(tuple(t[q : q + k]), []).append(q)
            votes = {}
            for p in range(len(w) - k + 1):
                for q in at.get(tuple(w[p : p + k]), ()):
                    votes.setdefault(p - q, set()).update(range(q, q + k))
            shift = 0 if phrase else n // licenses.DRIFT
            runs = []
            for d in sorted(votes):
                if not runs or d - runs[-1][-1] > shift:
                    runs.append([])
                runs[-1].append(d)
            for run in runs:
                covered = set().union(*(votes[d] for d in run))
                start, end = min(d + min(votes[d]) for d in run), max(d + max(votes[d]) for d in run) + 1
                if len(covered) == n if shift == 0 else len(covered) >= licenses.COVER * n and end - start <= licenses.STRETCH * n:
                    labels.add(label)
                    best = max(best, len(covered) / n)
                    if phrase:
                        places.append(start)
                        base.add(label)
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best

    out = queries.QUERIES["op11_licenses"](spark, folder)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str)
    assert got == sorted(((i, len(cut(t)), *found(cut(t))) for i, t, _ in DOCS), key=str)
    by = {r[0]: r for r in got}
    assert by[7][6] == "mit" and by[8][6] == "mit" and 0.8 <= by[8][7] < 1 and by[9][6] == ""  # whole, with words put in, a quarter
    for i, t, _ in DOCS:  # base places by the plainest rule
        w = cut(t)
        assert sum(w[p : p + len(x)] == x for _, x in ((a, b.split()) for a, b in licenses.PHRASES) for p in range(len(w))) == found(w)[0]


def test_licenses_large_catalogue_is_not_broadcast(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(map(str, licenses.scan(docs, licenses.catalogue(spark)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = licenses.scan(docs, licenses.catalogue(spark))
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString() and sorted(map(str, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = licenses.scan(docs, licenses.catalogue(spark, (), ())).collect()
    assert len(none) == len(DOCS) and all(r["labels"] == "" and r["n_base"] == 0 for r in none)


def _vectors():
    r = np.random.default_rng(8)
    some = [[float(x) for x in np.float32(r.normal(0, 0.3, 8))] for _ in range(400)]
    some += [some[0]] * 30 + [[0.0] * 8, [], [0.5] * 3, [-0.0001] * 8, [3.0] * 8]
    bad = [None, [0.1] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.0] * 7 + [float("-inf")]]
    each = [(900 - i if i % 9 else 2 * i, v, (None, 1, 2, 1)[i % 4]) for i, v in enumerate(some + bad)]
    each += [(None, some[1], None), (None, some[2], 1), each[5], each[5]]
    return [(*e, "x", "x", 9, 9) for e in each]


VECTORS = _vectors()


def _plain_codes(vectors, parts=4, entries=256, rounds=4):
    f = lambda x: int(np.floor(np.float64(x) * 1024))
    rows = [(i, [f(x) for x in v], lab) for i, v, lab, *_ in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    raw = {id(v): v for _, v, *_ in vectors}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, [x / 1024 for x in rows[n][1]], n))
    del raw
    full = [v + [0] * (width * parts - len(v)) for _, v, _ in rows]
    books = [[full[n][p * width : (p + 1) * width] for n in order[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            mine = [full[n][p * width : (p + 1) * width] for n in range(len(rows))]
            got = [near(x, books[p])[1] for x in mine]
            books[p] = [[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [x for x, g in zip(mine, got, strict=True) if g == j]) else e for j, e in enumerate(books[p])]
    out = []
    for (i, _, lab), v in zip(rows, full, strict=True):
        best = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], sha) for i, lab, c, e in out), key=str)


def test_codes_brute_force(spark, folder):
    out = queries.QUERIES["op12_vector_codes"](spark, folder)
    got = sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == _plain_codes(VECTORS)


def test_codes_of_any_size(spark, tmp_path):
    """Numbers beyond int64 are exact; fewer rows than entries make as many entries; a lone bad row gives no result."""
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 10.0 ** r.integers(0, 15), 6))], None, "", "", 0, 0) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vector string, code string, error long, part int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(x) for x in queries.QUERIES["op12_vector_codes"](spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == [(i, c, min(e, 2**63 - 1), min(t, 2**63 - 1), s) for i, c, e, t, s in _plain_codes(rows)]
    spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/bad/embeddings.parquet")
    assert queries.QUERIES["op12_vector_codes"](spark, f"{tmp_path}/bad").count() == 0


def test_nearest_is_exact_at_ties():
    r = np.random.default_rng(5)
    for p, spread in ((1, 3), (16, 2), (16, 1000), (64, 2**25), (300, 2**20)):
        book = r.integers(-spread, spread + 1, (256, p))
        book[200:] = book[:56]  # equal entries
        x = np.concatenate([book[r.integers(0, 256, 300)] + r.integers(-1, 2, (300, p)), r.integers(-spread, spread + 1, (300, p))])
        d = np.array([[sum(int(a) ** 2 for a in row) for row in x[i] - book] for i in range(len(x))], object)
        want = np.array([min(range(256), key=lambda j: (row[j], j)) for row in d])
        got, error = codes.nearest(x, book)
        assert (got == want).all() and all(int(e) == d[i, j] for i, (e, j) in enumerate(zip(error, want, strict=True)))
    same = np.zeros((5000, 8), np.int64)
    assert (codes.nearest(same, np.zeros((256, 8), np.int64))[0] == 0).all()


def test_codes_decode(spark, folder):
    rows = codes.kept(spark.read.parquet(f"{folder}/embeddings.parquet").where("size(embedding) = 8"))
    books = codes.trained(rows)
    back = codes.decoded(codes.encoded(rows, books), books).collect()
    for r in back:
        x = np.concatenate([books[p][b] for p, b in enumerate(r["code"])])
        assert np.allclose(r["vector"], x / 1024)


H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def _plain_manifest(docs):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = []
    for i, t, s in docs:
        of = lambda text: H("".join(map(field, (i, s, "de" if i else None, None if i == 5 else len(t or ""), text))))  # noqa: B023, E731
        rows.append((i, s, of(t), of(low(t)) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else of(t)))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][n : n + 16])) for n in range(0, len(out[-1]), 16)])
        return out

    def way(of, n):
        for level in of[:-1]:
            first = n // 16 * 16
            run = level[first : first + 16]
            yield run[: n - first], run[n - first + 1 :]
            n //= 16

    sources = sorted({s for _, s, *_ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in sources}
    built = {s: levels([r[2] for r in trees[s]]) for s in sources}
    over = levels([built[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for n, (i, _, leaf, checked) in enumerate(trees[s]):
            path = [*way(built[s], n), *way(over, k)]
            fold = checked
            for a, b in path:
                fold = H("".join(a) + fold + "".join(b))
            out.append((i, leaf, built[s][-1][0], over[-1][0], H("".join("".join(a + b) for a, b in path)), fold, fold == over[-1][0]))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_brute_force(spark, folder):
    got = sorted((tuple(r[c] for c in MANIFEST) for r in queries.QUERIES["op13_manifest"](spark, folder).collect()), key=str)
    want = _plain_manifest(DOCS)
    assert got == want and any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (257, 1, 16), (1,) * 40])
def test_manifest_shapes(spark, tmp_path, sizes):
    docs = [(1000 * s + n, f"Text {n}", f"s{s}") for s, size in enumerate(sizes) for n in range(size)]
    made = [(i, t, "de" if i else None, s, None if i == 5 else len(t)) for i, t, s in docs]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in MANIFEST) for r in queries.QUERIES["op13_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == _plain_manifest(docs)


def test_manifest_events_in_any_split():
    """Every split of the leaves over tasks climbs to the same nodes, whatever waits at the edges."""
    r = random.Random(1)
    for n in (2, 16, 17, 33, 300, 4097):
        leaves = [H(str(i)) for i in range(n)]
        cuts = sorted(r.sample(range(1, n), min(n - 1, 7)))
        rows = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            rows += manifest._climb((0, n, 1, i // 16, {i % 16: leaves[i]}) for i in range(a, b))
        done = [x for x in rows if x[-1]]
        while waits := [x for x in rows if not x[-1]]:
            at = {}
            for tree, size, level, parent, run, _ in waits:
                at.setdefault((tree, size, level, parent), {}).update({i: d for i, d in enumerate(run) if d})
            tasks = [[], [], []]
            for key, children in at.items():
                tasks[hash(key) % 3].append((*key, children))
            rows = [x for t in tasks for x in manifest._climb(sorted(t, key=lambda x: x[:4]))]
            done += [x for x in rows if x[-1]]
        want = [leaves]
        while len(want[-1]) > 1:
            want.append([H("".join(want[-1][i : i + 16])) for i in range(0, len(want[-1]), 16)])
        assert sorted((x[2], x[3], x[5]) for x in done) == sorted((k, i, d) for k, level in enumerate(want) if k for i, d in enumerate(level))


def test_statements_of_cases():
    for f in (licenses.scan, codes.op12_vector_codes, manifest.manifest):
        text = f.__doc__.lower()
        assert "null" in text and "empty table" in text and "columns" in text


def test_pii_pieces_equal_single_proposals(monkeypatch):
    """Features by arrays over pieces of any size are those of features(), and no proposal is lost at an edge."""
    from tessera.llm import pii

    r = random.Random(5)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeioué tel#$€@ card") for _ in range(r.randint(1, 9)))
    texts = ["".join(r.choice((w(), n(r.randint(1, 22)), " ", "(", ")", "-", ".", "+", "(555) ", " card ", "€", "x(at)y.com ", n(3) + "." + n(2) + ".", n(4) + " " + n(4) + " ", "ſ", "१")) for _ in range(r.randint(1, 60))) for _ in range(400)]
    want = [sorted(set(pii.proposals(t))) for t in texts]
    trees = pii.model()
    found = pii.detect(texts, trees)
    for few, piece, reach in ((0, 2048, 1 << 16), (0, 3, 1 << 16), (0, 50, 30), (10**9, 50, 30)):
        monkeypatch.setattr(pii, "FEW", few)
        monkeypatch.setattr(pii, "PIECE", piece)
        monkeypatch.setattr(pii, "REACH", reach)
        for t, spans in zip(texts, want, strict=True):
            blocks = list(pii._proposed(t))
            assert sorted({(s, e) for a, b, _ in blocks for s, e in zip(a.tolist(), b.tolist(), strict=True)}) == spans
            for a, b, x in blocks:
                assert x.tolist() == [[float(v) for v in pii.features(t, s, e)] for s, e in zip(a.tolist(), b.tolist(), strict=True)]
        assert pii.detect(texts, trees) == found


def test_pii_time_and_memory_on_numbers():
    import resource
    import time

    from tessera.llm import pii

    r = random.Random(6)
    trees = pii.model()
    numbers = lambda groups, size: " ".join("".join(r.choice("0123456789") for _ in range(size)) for _ in range(groups))
    for texts in ([numbers(333_333, 2)], [numbers(1000, 2) for _ in range(300)], [numbers(200_000, 4)], ["tel " + " tel ".join(numbers(1, 3) + "-" + numbers(1, 4) for _ in range(60_000))]):
        before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
        pii.detect(texts, trees)
        assert time.time() - t < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024  # KB


def test_substrings_of_texts_with_equal_short_hashes(spark, tmp_path):
    """Two texts without an id whose 32-bit hashes are equal are two texts: only the one that repeats a window loses words."""
    from pyspark.sql import functions as F

    many = spark.range(300_000).select("id", F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(21))).alias("text"))
    pair = many.withColumn("h", F.hash("text")).groupBy("h").agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).orderBy("h").first()
    assert pair is not None
    one, other = pair["t"][:2]
    rows = [(1, one), (None, one), (None, other)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op6_substrings"](spark, str(tmp_path)).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert got == [(1, 21, 0), (None, 21, 0), (None, 21, 21)]
