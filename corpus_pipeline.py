"""The corpus pipeline: raw documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. run() applies them in turn, cutting lineage after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, mixing, pii, simhash, toxicity

#: A classifier and a latent search decide in two of the stages, which SQL cannot express.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labels, scores below one half; nulls and repeats as in accepted()."""
    return toxicity.accepted(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id; null texts and ids as in keep_one()."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, null ids as in clean()."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows and is null where the text is null."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions of every document: how much of it the mix takes, and
    when; range-sorted by first position. Null texts hold no words, a null source is one of its own."""
    return mixing.ordered(mixing.mix(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents. Empty tables give no rows; what a stage does with null texts and ids, repeated rows and rows
    that share an id is said with the operator that it calls. Columns beyond those of documents pass through the first four.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.durable(docs)
    return docs
