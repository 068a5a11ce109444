"""Spaces are learned from every passage of every document."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import decontamination as D


def test_every_document_counts_in_every_pass(spark, monkeypatch):
    """120,000 passages, of which an earlier bound left out a sixth: each sum over tasks reads all documents."""
    n = 4000
    words = "transform(sequence(0, 959), x -> concat('w', (xxhash64(id, x) & 4095)))"
    d = spark.range(n).selectExpr("id AS doc_id", f"array_join({words}, ' ') AS text").repartition(8).persist()
    item = " ".join(d.where("doc_id = 5").first()["text"].split()[100:140])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    total, read = D.totals.total, []
    monkeypatch.setattr(D.totals, "total", lambda df, *a, **k: (read.append(df.count()), total(df, *a, **k))[1])
    got = [(x["doc_id"], x["item_id"], x["cover"]) for x in D.leaks(d, bench).collect()]
    d.unpersist()
    assert got == [(5, 7, 1.0)] and read == [n] * 3  # frequencies and the two passes of the fit


def test_spaces_of_blocks_are_those_of_plain_svds(spark):
    """Two blocks learned at once; each space keeps as much of the passages, in its items' columns, as singular vectors do,
    though half of the documents' words are in no item."""
    r = random.Random(4)
    topics = [["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)] for _ in range(9)]
    text = lambda k, upto: " ".join(r.choice(topics[k][:upto]) for _ in range(D.FIT_WORDS))
    texts = [text(n % 9, 40) for n in range(450)]
    items = [[text(n % 9, 20) for n in range(18)], [text(n % 4, 20) for n in range(12)]]
    idf = np.random.default_rng(2).uniform(0.5, 3, 1 << D.BITS).astype(np.float32)
    arrays = [pa.array(x) for x in items]
    of = [(x, D.known_features(x)) for x in arrays]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = D.latent_spaces(docs, of, idf, len(texts), 8)
    for own, (_, known), latent in zip(items, of, got, strict=True):
        rows = np.zeros((len(texts) + len(own), 1 << D.BITS), np.float32)
        for n, t in enumerate(texts + own):
            f = np.unique(D.features(D._words(pa.array([t]))[0]))
            rows[n, f] = idf[f]
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        rows[len(texts) :] *= np.sqrt(D.ITEMS_WEIGH * len(texts) / len(own))
        rows, v = rows[:, known], latent / idf[known, None]
        assert np.allclose(v.T @ v, np.eye(8), atol=1e-3)
        assert (np.linalg.norm(rows @ v, axis=1) ** 2).sum() >= 0.99 * (np.linalg.svd(rows)[1][:8] ** 2).sum()


def test_the_pipeline_learns_from_all_that_reach_it(spark, tmp_path, monkeypatch):
    """The stage's spaces and frequencies are of all documents that the stages before kept, and only leaks go."""
    import corpus_pipeline

    n = 4000
    words = "transform(sequence(0, 959), x -> concat('w', (xxhash64(id, x) & 4095)))"
    d = spark.range(n).selectExpr("id AS doc_id", f"array_join({words}, ' ') AS text").repartition(8).persist()
    item = " ".join(d.where("doc_id = 5").first()["text"].split()[100:140])
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    total, read = D.totals.total, []
    monkeypatch.setattr(D.totals, "total", lambda df, *a, **k: (read.append(df.count()), total(df, *a, **k))[1])
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, d, str(tmp_path))
    assert {x["doc_id"] for x in left.select("doc_id").collect()} == set(range(n)) - {5} and read == [n] * 3
    d.unpersist()
