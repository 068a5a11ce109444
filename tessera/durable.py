"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks rather than shuffled with what it is joined to.
SENT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else the one set on the context. Only a local
    master, whose tasks all run on this machine, falls back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: what follows reads these rows, in these partitions, whatever is lost."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as compressed columns in the shared folder: a cut like durable() for rows as many as the input's, of which a
    checkpoint would keep each in full width. What follows reads only the columns that it needs. The files go with the driver."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def looked_up(df: DataFrame) -> DataFrame:
    """df, counted, with a hint to broadcast it where it is small: what is joined to it is then not shuffled."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= SENT else df
