"""The latest row of each key from a stream in update mode, kept as changes and a folded base.

Each micro-batch is written as one folder of changes named by its batch number, so a batch that runs
again after a failure overwrites what it wrote before.  Every ``every`` batches all changes so far are folded into a
base by one aggregation; what the base before it covers is then deleted.  Nothing is rewritten in between, whatever
the number of keys, and a hot key has one row a batch.  Readers take the newest whole base and the changes after it.

Defined cases: of several rows of one key in a batch the largest row counts, null keys are one key, an empty batch is an empty
folder, and reading before the first batch gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class LatestRows:
    """The snapshot below ``root`` of rows with ``schema``, one for each value of ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: T.StructType, every: int = 50):
        self.spark, self.root, self.keys, self.schema, self.every = spark, root.rstrip("/"), list(keys), schema, every
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        """The batch numbers of the folders that were written to the end."""
        folder = self._path(f"{self.root}/{kind}")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.root}/{kind}/{n}/_SUCCESS")))

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/{batch_id:012d}"

    def _state(self, bases: list[int], last: int | None = None) -> DataFrame:
        """The latest rows by the newest of ``bases`` and the changes after it, up to batch ``last``."""
        base = bases[-1] if bases else -1
        kept = [(n, self._folder("changes", n)) for n in self._whole("changes") if n > base and (last is None or n <= last)]
        kept += [(base, self._folder("base", base))] * (base >= 0)
        if not kept:
            return self.spark.createDataFrame([], self.schema)
        folder = F.regexp_extract(F.input_file_name(), r"/(\d{12})/[^/]*$", 1).cast("long")
        rows = self.spark.read.schema(self.schema).parquet(*[path for _, path in kept]).select(F.struct("*").alias("row"), folder.alias("batch"))
        named = [F.col(f"row.`{k}`").alias(f"_k{i}") for i, k in enumerate(self.keys)]
        return rows.groupBy(*named).agg(F.max_by("row", F.struct("batch", "row")).alias("row")).select("row.*")

    def read(self) -> DataFrame:
        """The latest row of each key as of now."""
        return self._state(self._whole("base"))

    def handler(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that takes the changed rows of each batch."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            batch.select(*self.schema.names).write.mode("overwrite").parquet(self._folder("changes", batch_id))
            if (batch_id + 1) % self.every == 0:
                # a batch that runs again folds from the same base as before
                earlier = [b for b in self._whole("base") if b < batch_id]
                self._state(earlier, batch_id).write.mode("overwrite").parquet(self._folder("base", batch_id))
                for kind, done in (("changes", earlier[-1] if earlier else -1), ("base", earlier[-1] - 1 if earlier else -1)):
                    for n in self._whole(kind):
                        if n <= done:
                            self._fs.delete(self._path(self._folder(kind, n)), True)

        return handle


def run_latest(stream: DataFrame, root: str, keys: Sequence[str], every: int = 50) -> DataFrame:
    """Run a stream in update mode over what is there now into :class:`LatestRows`, and read it."""
    kept = LatestRows(stream.sparkSession, f"{root.rstrip('/')}/rows", keys, stream.schema, every)
    query = stream.writeStream.outputMode("update").foreachBatch(kept.handler()).option("checkpointLocation", f"{root.rstrip('/')}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept.read()
