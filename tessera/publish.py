"""A run over given tables that is written, audited and only then published.

Every step writes its table to the folder of its version and is entered in the version's manifest; its checks run on what
was written. When all steps have passed, one rename of a small file makes the version the published one. A failed check or a
lost driver leaves the published version as it was, and the same run, started again, goes on after the last step entered.

`python -m tessera.publish TABLES FOLDER VERSION` publishes the order layers of a folder of tables.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import feeds, quality
from .plans import catalogue

#: A step's table from the tables of steps before it; a step's checks from its table and those.
Made = Callable[[Callable[[str], DataFrame]], DataFrame]
Checked = Callable[[DataFrame, Callable[[str], DataFrame]], Sequence[DataFrame]]


@dataclass
class Step:
    name: str
    make: Made
    checks: Checked = field(default=lambda made, tables: ())


class Store:
    """Small files of a folder that any of Spark's file systems may hold."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder.rstrip("/"), spark._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def read(self, name: str) -> str | None:
        path, conf = self._path(name), self.spark._jsc.hadoopConfiguration()
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file has the old text or the new one at any time: the new one is written beside it and renamed over it."""
        conf = self.spark._jsc.hadoopConfiguration()
        new, path = self._path(f"{name}.new"), self._path(name)
        stream = path.getFileSystem(conf).create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        at = path.getFileSystem(conf).makeQualified(path)
        files.FileContext.getFileContext(at.toUri(), conf).rename(new, path, over)


def published(spark: SparkSession, folder: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the published version, or of one named."""
    version = version or Store(spark, folder).read("published")
    if version is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{version}/{table}")


def run(spark: SparkSession, folder: str, version: str, steps: Sequence[Step]) -> dict:
    """Write, check and publish a version; its manifest: {"steps": {name: {"rows", "columns", "checks"}}}.

    Steps that the manifest holds are not made again: their tables are read. A step counts as done when it is written and its
    checks have passed; what an interrupted one left is overwritten. A version that is published already is returned as it
    is. Raises with the names of the checks that fail. Steps are named once each; a version is a folder of its own.
    """
    if len({s.name for s in steps}) < len(steps):
        raise ValueError("a step is named twice")
    store = Store(spark, folder)
    manifest = json.loads(store.read(f"{version}.json") or '{"steps": {}}')
    done = manifest["steps"]
    if store.read("published") == version:
        return manifest

    def tables(name: str) -> DataFrame:
        if name not in done:
            raise ValueError(f"{name} is no step before this one")
        return spark.read.parquet(f"{store.folder}/{version}/{name}")

    for step in steps:
        if step.name in done:
            continue
        path = f"{store.folder}/{version}/{step.name}"
        step.make(tables).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        checks = list(step.checks(made, tables))
        passed = [r["check_name"] for r in feeds.enforce(quality.report(checks)).collect()] if checks else []
        done[step.name] = {"rows": made.count(), "columns": made.schema.simpleString(), "checks": sorted(passed)}
        store.replace(f"{version}.json", json.dumps(manifest, sort_keys=True, indent=1))
    store.replace("published", version)
    return manifest


def order_layers(spark: SparkSession, sf_dir: str) -> list[Step]:
    """The layers of orders: lines as staged, customers, orders and what each layer adds up to, with hard checks between them."""
    of = lambda f: lambda tables: f(spark, sf_dir)
    raw = lambda name: catalogue.t(spark, sf_dir, name)
    return [
        Step("stg_lineitem", of(catalogue.stg_lineitem), lambda made, _: [quality.violations(raw("lineitem").agg(_count()).exceptAll(made.agg(_count())), _true(), "lines_kept")]),
        Step("customer_dim", of(catalogue.customer_dim), lambda made, _: [quality.unique(made, ["customer_key"], "customer_key_unique"), quality.not_null(made, "customer_key", "customer_key_not_null")]),
        Step("fct_orders", of(catalogue.fct_orders), lambda made, tables: [quality.unique(made, ["order_key"], "order_key_unique"), quality.relationship(made, "customer_key", tables("customer_dim"), "customer_key", "order_has_customer")]),
        Step("layer_totals", of(catalogue.layer_totals), lambda made, tables: [quality.violations(made.where("layer = 'orders'").select("n").exceptAll(tables("fct_orders").agg(_count())), _true(), "orders_add_up")]),
    ]


def _count():
    return catalogue.F.count("*").alias("n")


def _true():
    return catalogue.F.lit(True)


def main(arguments: list[str]) -> int:
    from .session import local_session

    tables, folder, version = arguments
    s = local_session()
    try:
        print(json.dumps(run(s, folder, version, order_layers(s, tables)), sort_keys=True, indent=1))
        return 0
    except ValueError as e:  # a hard check
        print(e, file=sys.stderr)
        return 1
    finally:
        s.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
