"""Runs over given tables: checks before publication, an atomic switch, resumption; and stores by declared schema."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera import publish
from tessera.operators import quality
from tessera.sources import files, postings

SF = "/root/testdata/sf0.001"


def test_order_layers_are_published(spark, tmp_path):
    made = publish.run(spark, str(tmp_path), "v1", publish.order_layers(spark, SF))
    assert list(made["steps"]) and set(made["steps"]) == {"stg_lineitem", "customer_dim", "fct_orders", "layer_totals"}
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert publish.published(spark, str(tmp_path), "fct_orders").count() == orders == made["steps"]["fct_orders"]["rows"]
    assert (tmp_path / "published").read_text() == "v1" and json.loads((tmp_path / "v1.json").read_text()) == made
    assert publish.run(spark, str(tmp_path), "v1", []) == made  # published already


def test_a_failed_check_leaves_the_published_version(spark, tmp_path):
    at, calls = str(tmp_path), []

    def steps(bad, broken=False):
        def first(tables):
            calls.append("first")
            return spark.range(5)

        def second(tables):
            calls.append("second")
            if broken:
                raise RuntimeError("lost")
            return tables("first").where(F.lit(not bad) | (F.col("id") > 0))

        return [publish.Step("first", first), publish.Step("second", second, lambda made, tables: [quality.violations(tables("first").join(made, "id", "left_anti"), F.lit(True), "all_kept")])]

    with pytest.raises(ValueError, match="nothing is published"):
        publish.published(spark, at, "second")
    publish.run(spark, at, "a", steps(False))
    with pytest.raises(ValueError, match=r"all_kept \(1\)"):
        publish.run(spark, at, "b", steps(True))
    assert publish.Store(spark, at).read("published") == "a" and publish.published(spark, at, "second").count() == 5
    with pytest.raises(RuntimeError):
        publish.run(spark, at, "b", steps(False, broken=True))
    assert publish.Store(spark, at).read("published") == "a"
    publish.run(spark, at, "b", steps(False))  # mended: only the failed step runs again
    assert publish.Store(spark, at).read("published") == "b" and calls == ["first", "second", "first", "second", "second", "second"]
    assert publish.published(spark, at, "second", "a").count() == 5
    with pytest.raises(ValueError, match="no step before"):
        publish.run(spark, at, "c", [publish.Step("x", lambda tables: tables("later"))])
    with pytest.raises(ValueError, match="twice"):
        publish.run(spark, at, "c", [publish.Step("x", lambda t: spark.range(1))] * 2)


def test_a_store_has_its_declared_schema(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    back = files.rebuild(spark.range(3).selectExpr("cast(id AS string) AS id", "id * 2 AS name", "1 AS more"), str(tmp_path / "s"), schema)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in schema] and sorted(map(tuple, back.collect())) == [(0, "0"), (1, "2"), (2, "4")]
    assert files.rebuild(back.limit(0), str(tmp_path / "t"), schema).count() == 0


def test_scripts_run_statement_by_statement(spark):
    out = files.run_script(spark, "-- a comment\nSELECT 1 AS a;\n\nSELECT 2 AS b\n;")
    assert [d.columns for d in out] == [["a"], ["b"]]


def test_matching_postings_may_be_limited(spark):
    rows = [("s", "b", str(n), "Engineer" if n % 2 else "Cook", "Berlin" if n < 6 else None) for n in range(9)]
    jobs = spark.createDataFrame(rows[::-1], "source string, token string, job_id string, title string, location string")
    ids = lambda df: [r["job_id"] for r in df.collect()]
    assert ids(postings.matching(jobs, title="engineer", limit=2)) == ["1", "3"]  # filters first, then the first in order
    assert ids(postings.matching(jobs, title="engineer", location="BERL", limit=9)) == ["1", "3", "5"]
    assert sorted(ids(postings.matching(jobs, location="berlin"))) == ["0", "1", "2", "3", "4", "5"] and ids(postings.matching(jobs, limit=0)) == []
