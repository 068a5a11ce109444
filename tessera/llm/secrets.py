"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content (a blob). The ledger says which rules, by name and
version, have been run over which blob, and what they found. A scan looks only at pairs of blob and rule version that
the ledger lacks, one copy of each blob, and appends what it finds; reports join the ledger's findings back to all
documents that hold the blob. A second scan of the same versions looks at nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern with its version. need: strings of which a lower-cased text must hold one; keep: tests a match."""

    name: str
    version: int
    pattern: str
    flags: int = 0
    need: tuple[str, ...] = ()
    keep: Callable[[re.Match], bool] | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, ("password", "passwd", "secret", "token", "apikey", "api_key"), _long_value),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, ("akia",), lambda m: m.end() - m.start() >= 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: What the scan adds: formats that name themselves.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, ("private key-----",)),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, ("eyj",)),
)
RULES = BASE + ADDED


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, leftmost and non-overlapping for each rule."""
    low = text.lower()
    out = []
    for r in rules:
        if not r.need or any(x in low for x in r.need):
            out += [(r.name, *m.span()) for m in re.finditer(r.pattern, text, r.flags) if not r.keep or r.keep(m)]
    return out


_SCHEMA = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {r.key: r for r in rules}
        for batch in batches:
            blob, text, todo = (c.to_pylist() for c in batch.columns)
            spans = [[{"rule": a, "start": s, "end": e} for a, s, e in find(t or "", tuple(of[k] for k in ks))] for t, ks in zip(text, todo, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((blob, todo, spans), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def addressed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo) of the blobs for which the ledger lacks some of the rule versions todo, each blob once.

    A null text is the empty one. Rows with a null doc_id count like others; an empty table has no blobs.
    """
    a = addressed(docs).select(common.row_id().alias("did"), "blob", "text")
    heads = a.groupBy("blob").agg(F.min("did").alias("did"))
    want = F.array(*[F.lit(r.key) for r in rules])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))  # a row a blob and rule version
    left = F.array_except(want, F.coalesce("seen", F.array().cast("array<string>")))
    todo = heads.join(seen, "blob", "left").select("blob", "did", left.alias("todo")).where(F.size("todo") > 0)
    return a.join(todo, ["did", "blob"]).select("blob", "text", "todo")


def scanned(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rules, spans): what the rules todo find in each text."""
    return texts.mapInArrow(_scan(rules), LEDGER).dropDuplicates(["blob"])  # rows that share a doc_id and a text


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) of every document, by the ledger.

    spans: array of (rule, start, end), sorted by start and then by the order of rules; empty where nothing was found.
    Findings of rule versions that are not among rules stay in the ledger and are not reported. A null text is the empty
    one, a null doc_id is passed on, repeated rows are reported each; an empty table gives no rows. A blob that many documents hold is joined by adaptive splitting of its partition.
    """
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.key)])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    every = ledger.where(F.size("spans") > 0).select("blob", "rules", F.explode("spans").alias("s")).where(F.array_contains("rules", F.try_element_at(current, F.col("s.rule"))))
    placed = F.struct(F.col("s.start").alias("start"), rank[F.col("s.rule")].alias("rank"), F.col("s.end").alias("end"), F.col("s.rule").alias("rule"))
    found = every.groupBy("blob").agg(F.array_sort(F.collect_set(placed)).alias("spans"))  # the spans of one text
    out = addressed(docs).select("doc_id", "blob").join(found, "blob", "left")
    spans = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,rule:string>>")), lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "blob", spans.alias("spans"))


class Ledger:
    """A ledger kept as a Parquet folder in shared storage, appended to by each scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(LEDGER).parquet(self.folder)
        return self.spark.createDataFrame([], LEDGER)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs of blob and rule version that the ledger lacks and append them; a lost or repeated task adds
        nothing twice, as only committed files count."""
        scanned(unseen(docs, self.rows(), rules), rules).write.mode("append").parquet(self.folder)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Bring the ledger up to date with docs, then report from it: (doc_id, blob, spans) as in report()."""
        self.update(docs, rules)
        return report(docs, self.rows(), rules)


def _joined(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_secrets(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Secrets of every document, by way of a ledger: in a given folder, or a fresh one in the shared checkpoint folder.

    Null and empty texts have none; a null doc_id is passed on; repeated rows are reported each; an empty table gives no
    rows; other columns are ignored.
    """
    ledger = Ledger(spark, folder or f"{common.shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    found = ledger.scan(common.table(spark, sf_dir, "documents"))
    names = [r.name for r in BASE]
    base = F.filter("spans", lambda s: s["rule"].isin(names))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, names), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
