"""The toxicity regression and its calibration learn from every labelled row that may be learned from."""

import hashlib
import random
import zlib

import numpy as np

from tessera.llm import toxicity

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def corpus(n: int) -> tuple[list[tuple[int, str]], list[tuple[int, int]], set[int]]:
    """Texts of which every second is toxic by one word, but the toxic ones that come last by a hash of their id by another."""
    r = random.Random(8)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    late = {i for i in sorted((i for i in range(0, n, 2) if fold(i) > 1), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[2000:]}
    word = lambda: "".join(r.choice("lmnoprstuaei") for _ in range(5))
    texts = [(i, " ".join([word(), ("zzqqxx" if i in late else "wretchbag") if i % 2 == 0 else word(), word()])) for i in range(n)]
    return texts, [(i, 1 - i % 2) for i in range(n)], late


def test_no_labelled_row_is_left_out(spark):
    """2,400 rows a class: a word that only rows beyond an earlier bound of 2,000 hold is learned; the weights are those of
    a plain fit to all rows, whatever the partitions."""
    texts, labels, late = corpus(8000)
    assert len(late) > 300
    d, lab = spark.createDataFrame(texts, DOCS), spark.createDataFrame(labels, LABELS)
    one, two = (toxicity.train(d.repartition(k), lab) for k in (3, 7))
    assert (one.weight == two.weight).all() and one.intercept == two.intercept
    new, known, none = one.score([f"munero {x} plasti" for x in ("zzqqxx", "wretchbag", "tirone")])
    assert new > 0.9 and known > 0.9 and none < 0.5
    own = [(t, y) for (i, t), (_, y) in zip(texts, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 > 1]
    rows, y = [toxicity._squeezed(f) for f in toxicity.grams([t for t, _ in own])], np.array([y for _, y in own])
    rate = np.zeros((2, 1 << toxicity.BITS))
    for f, k in zip(rows, y, strict=True):
        rate[k, np.frombuffer(f, np.int32)] += 1
    q, p = ((rate[k] + toxicity.ALPHA) / ((y == k).sum() + 2 * toxicity.ALPHA) for k in (0, 1))
    scale = np.where(rate.sum(0) > 0, np.log(p / q), 0)
    w, _ = toxicity.logistic(toxicity.Rows(rows), scale, y, toxicity.RIDGE)
    w = w * scale
    a = (one.weight @ w) / (w @ w)  # the calibration's slope
    assert a > 0 and np.allclose(one.weight, a * w, rtol=1e-9, atol=1e-12)


def test_packs_give_back_what_they_hold():
    texts = ["", "ab", "abc abd", None, "häß " * 50, *("x%d y%d" % (i, 7 * i) for i in range(300)), ""]
    whole = toxicity.Rows([toxicity._squeezed(f) for f in toxicity.grams(texts)])
    back = toxicity.Rows.unpacked(whole.packed(), len(texts), len(whole.low))
    feature, many = back.features()
    for f, own in zip(toxicity.grams(texts), np.split(feature, np.cumsum(many)[:-1]), strict=True):
        assert own.tolist() == sorted(f.tolist())


def test_every_row_calibrates(spark):
    """5,000 rows: the line is the penalised optimum over all of them, whatever the partitions."""
    r = np.random.default_rng(3)
    z = r.normal(0, 3, 5000)
    y = (r.random(5000) < 1 / (1 + np.exp(-(0.7 * z - 1.2)))).astype(int)
    scored = spark.createDataFrame(list(zip(z.tolist(), y.tolist(), strict=True)), "z double, toxic int")
    a, c = toxicity.calibration(scored.repartition(5))
    assert (a, c) == toxicity.calibration(scored.repartition(2))
    off = 1 / (1 + np.exp(-(a * z + c))) - y
    assert abs(off @ z + 0.5 * (a - 1)) < 1e-2 and abs(off.sum() + 0.5 * c) < 1e-2
