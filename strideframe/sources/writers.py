"""Sinks: result folders, keyed snapshots and user-day replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.operators.keyed import insert_absent, upsert
from strideframe.session import checkpointed


def write_result(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a result table as parquet, csv (with header) or json."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(kind).option("header", True).save(path)


def next_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str, keep_old_if_null: Sequence[str] = (), *, only_absent: bool = False) -> None:
    """Write the merged snapshot of a keyed table to a new folder."""
    merged = insert_absent(old, new, keys) if only_absent else upsert(old, new, keys, keep_old_if_null)
    merged.write.mode("errorifexists").parquet(path)


def user_bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def replace_user_days(spark: SparkSession, new: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace all rows of the user-days in ``new`` in a table laid out by (user_bucket, day).

    Only the touched partitions are rewritten: their other user-days are read back, joined
    with the new rows, checkpointed (the folder is both read and written) and swapped in
    with a dynamic partition overwrite.  Running it twice changes nothing.
    """
    fresh = new.withColumn("user_bucket", user_bucket(buckets))
    merged = fresh
    if _exists(spark, path):
        old = spark.read.schema(fresh.schema).parquet(path)
        touched = old.join(fresh.select("user_bucket", "day").distinct(), ["user_bucket", "day"], "left_semi")
        kept = touched.join(fresh.select("user_id", "day").distinct(), ["user_id", "day"], "left_anti")
        merged = checkpointed(kept.select(fresh.columns).unionByName(fresh))
    (
        merged.repartition("user_bucket", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("user_bucket", "day").parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet folder has any file yet."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").isEmpty()
    except AnalysisException:
        return False
