"""Answers of a slow or costly tagger, asked in requests of some rows and kept in a ledger by content and model version."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable

#: Rows of a request.
REQUEST = 25
#: Rows whose requests are numbered together, on average.
BUCKET = 1_000
ANSWER = "vendor_guess string, category_guess string, confidence double, new_vendor_flag int"
LEDGER = f"content string, version string, {ANSWER}"
FIELDS = [f.split()[0] for f in ANSWER.split(", ")]

#: Takes {id: text}, gives a dict with id and the fields of ANSWER for each; called in tasks, so it must be picklable.
Ask = Callable[[dict[str, str]], list[dict]]


class Incomplete(RuntimeError):
    """An answer that leaves ids out, repeats or invents them; nothing of it is kept."""


def checked(sent: dict[str, str], answers: list[dict]) -> list[dict]:
    """The answers if they hold every id that was sent exactly once."""
    got = [a["id"] for a in answers]
    if len(got) != len(sent) or set(got) != set(sent):
        raise Incomplete(f"sent {len(sent)} rows, got {len(got)} with {len(set(got) & set(sent))} of their ids")
    return answers


def ledger_rows(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(content, answer fields) of a version, one row a content."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    kept = spark.read.schema(LEDGER).parquet(folder).where(F.col("version") == version)
    return kept.groupBy("content").agg(F.min(F.struct(*FIELDS)).alias("a")).select("content", "a.*")


def ask_unseen(texts: DataFrame, folder: str, version: str, ask: Ask, request: int = REQUEST, requests: int = 1) -> int:
    """Asks for every distinct text of (text) that the ledger lacks in this version; returns how many those were.

    A task makes so many requests and then commits its file on its own, whatever becomes of the job: with one request a task,
    neither a lost task nor a run after a failed one asks again for a row whose answer was committed. An incomplete answer
    fails its task. Null texts are not asked for.
    """
    spark = texts.sparkSession
    own = texts.where("text is not null").select(F.sha2("text", 256).alias("content"), "text").dropDuplicates(["content"])
    unseen = durable(own.join(ledger_rows(spark, folder, version), "content", "left_anti"))
    n = unseen.count()
    if not n:
        return 0
    buckets = -(-n // BUCKET)
    unseen = unseen.withColumn("bucket", F.pmod(F.xxhash64("content"), F.lit(buckets)))
    most = unseen.groupBy("bucket").count().agg(F.max("count")).first()[0]  # one number
    slots = -(-most // request)
    number = F.expr(f"bucket * {slots} + (row_number() over (partition by bucket order by content) - 1) div {request}")
    numbered = unseen.withColumn("number", number)
    tasks = -(-buckets * slots // requests)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames))  # the rows of a task's requests
        for _, part in whole.groupby("number"):
            sent = dict(zip(part["content"], part["text"], strict=True))
            answers = pd.DataFrame(checked(sent, ask(sent)))
            yield answers.rename(columns={"id": "content"}).assign(version=version)[["content", "version", *FIELDS]]

    def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [f for f in frames if len(f)]
        return run(iter(some)) if some else iter(())

    asked = numbered.repartitionById(tasks, F.expr(f"cast(number div {requests} as int)")).select("number", "content", "text").mapInPandas(filled, LEDGER)
    asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    return n


def tagged(rows: DataFrame, folder: str, version: str, ask: Ask, request: int = REQUEST, requests: int = 1) -> DataFrame:
    """rows with the answer to their column text; unseen texts are asked for at once, null texts have null answers. Raises
    Incomplete if the ledger then lacks a text. Other columns pass through, but for names of answer fields, which are replaced."""
    rows = rows.drop(*FIELDS)
    ask_unseen(rows.select("text"), folder, version, ask, request, requests)
    known = ledger_rows(rows.sparkSession, folder, version).withColumnRenamed("content", "_content")
    out = rows.withColumn("_content", F.sha2("text", 256))
    lost = out.where("_content is not null").join(known, "_content", "left_anti").limit(1).count()
    if lost:
        raise Incomplete("the ledger lacks texts that were asked for")
    return out.join(known, "_content", "left").drop("_content")
