"""The ledger of a tagger: what is answered is not asked again, incomplete answers are refused."""

import os
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle

from tessera.operators import resolve, tagging

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def guess(sent):
    return [{"id": i, "vendor_guess": t.split()[0], "category_guess": "c", "confidence": 0.5, "new_vendor_flag": 0} for i, t in sent.items()]


def logging_to(log, poison=None):
    """A stand-in that notes each text it answers, and fails once, late, on the poisoned one."""

    def ask(sent):
        mark = f"{log}.failed"
        if poison in sent.values() and not os.path.exists(mark):
            open(mark, "w").close()
            time.sleep(4)
            raise OSError("gone")
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in sent.values()))
        return guess(sent)

    return ask


def noted(log):
    with open(log) as f:
        return Counter(f.read().splitlines())


def test_a_failed_run_repeats_no_answered_row(spark, tmp_path):
    texts = [f"v{n} store" for n in range(130)]
    rows = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts + texts[:40])] + [(999, None, "x")], "n long, text string, confidence string")
    folder, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    ask = logging_to(log, texts[7])
    with pytest.raises(Exception, match="gone"):
        tagging.tagged(rows, folder, "m1", ask, request=10)
    kept = tagging.ledger_rows(spark, folder, "m1").count()
    assert 100 <= kept == sum(noted(log).values()) < 130
    got = {r["n"]: r for r in tagging.tagged(rows, folder, "m1", ask, request=10).collect()}
    assert noted(log) == Counter(texts)  # each text once over both runs
    assert len(got) == 171 and got[3]["vendor_guess"] == "v3" == got[133]["vendor_guess"] and got[3]["confidence"] == 0.5
    assert got[999]["vendor_guess"] is None and got[999]["new_vendor_flag"] is None
    assert tagging.ask_unseen(rows, folder, "m1", ask) == 0 and tagging.ask_unseen(rows, folder, "m2", ask) == 130
    assert set(noted(log).values()) == {2}  # another model version asks anew


@pytest.mark.parametrize("spoil", [lambda a: a[1:], lambda a: a + a[:1], lambda a: [{**a[0], "id": "x"}, *a[1:]], lambda a: []])
def test_incomplete_answers_are_refused(spark, tmp_path, spoil):
    rows = spark.createDataFrame([("a b",), ("c d",)], "text string")
    with pytest.raises(Exception, match="sent 2 rows"):
        tagging.tagged(rows, str(tmp_path / "l"), "m", lambda sent: spoil(guess(sent)))
    assert tagging.ledger_rows(spark, str(tmp_path / "l"), "m").count() == 0


def test_requests_are_bounded_and_empty_tables_ask_nothing(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def ask(sent):
        with open(log, "a") as f:
            f.write(f"{len(sent)}\n")
        return guess(sent)

    rows = spark.range(2300).selectExpr("concat('w', id, ' x') as text")
    assert tagging.tagged(rows, str(tmp_path / "l"), "m", ask, requests=7).where("vendor_guess = split(text, ' ')[0]").count() == 2300
    with open(log) as f:
        sizes = [int(x) for x in f]
    assert sum(sizes) == 2300 and max(sizes) == tagging.REQUEST and len(sizes) <= 2300 // 25 + 3
    assert tagging.tagged(rows.limit(0), str(tmp_path / "e"), "m", ask).count() == 0


def test_answers_join_the_resolver(spark, tmp_path):
    found = spark.createDataFrame([("ACME X", "unmatched", 0.1, None), ("BOLT", "exact", 1.0, "Bolt")], "core string, method string, score double, vendor string")
    tail = found.where("method = 'unmatched'").selectExpr("core", "core as text")
    tags = tagging.tagged(tail, str(tmp_path / "l"), "m", guess)
    got = {r["core"]: (r["final_method"], r["final_vendor"]) for r in resolve.merge_tags(found, tags).collect()}
    assert got == {"ACME X": ("tagger_tail", "ACME"), "BOLT": ("exact", "Bolt")}
