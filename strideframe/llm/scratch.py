"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.session import scratch_root


def run_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Without that setting a local master gets a temporary folder; on a cluster it is an error.
    """
    path = f"{scratch_root(spark).rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def settled(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a table below ``folder`` and read it back: later jobs start from the files.

    A lost executor costs nothing that was settled before, and an iterative job keeps a short
    lineage.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df`` (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys up to this number are broadcast (a few tens of MB); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def without_keys(docs: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, h_text) is not in the settled table ``keys``.

    Broadcasting a counted, small table of keys spares the texts a shuffle.
    """
    key, digest = free_name(docs, "_id"), free_name(docs, "_hash")
    few = keys.select(F.col("doc_id").alias(key), F.col("h_text").alias(digest))
    if few.count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    same = [F.col(doc_id).eqNullSafe(F.col(key)), F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)) == F.coalesce(digest, F.lit(0))]
    return docs.join(few, same, "left_anti")
