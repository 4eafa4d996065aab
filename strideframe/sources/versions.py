"""Tables that change together: immutable segments and a manifest that is swapped last.

A store folder holds segments and numbered manifests.  A segment has one folder per table
and one with the user-days that it replaces; the manifest lists the segments in order.
A change writes its segment first, table by table, and then puts the next manifest in place by
one rename; whatever fails before that leaves readers on the old manifest, for all tables.
Two writers cannot take the same number: the second one fails and may start anew.

Readers take the newest manifest and hide rows whose user-day is replaced by a later
segment, by one join with the (slim) replaced days.  :meth:`Store.compact` writes the visible rows as one
segment.  Rows are written as they are dealt, so a user-day with a third of the rows has as many writers as
it has partitions.  Tables have ``user_id`` and ``day``; segments of a table have equal columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

_KEY = ["user_id", "day"]


class Store:
    """Tables below ``root``; every method reads the newest manifest first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The newest manifest's number; 0 without one."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def segments(self) -> list[str]:
        """The segments of the newest manifest, oldest first."""
        version = self._version()
        if not version:
            return []
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{version:012d}").first()[0])["segments"]

    def _publish(self, version: int, segments: list[str]) -> int:
        """Put manifest ``version`` in place, unless somebody else has."""
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{version:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise FileExistsError(f"version {version} is there already")
        return version

    def _at(self, segment: str, table: str) -> str:
        return f"{self.root}/segments/{segment}/{table}"

    def _held(self, segments: list[str], table: str) -> DataFrame | None:
        """Rows of a table in all segments, with their place in the list."""
        parts = [self.spark.read.parquet(self._at(s, table)).withColumn("_seg", F.lit(i)) for i, s in enumerate(segments) if self._fs.exists(self._path(self._at(s, table)))]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _visible(self, segments: list[str], table: str) -> DataFrame | None:
        rows, days = self._held(segments, table), self._held(segments, "_days")
        if rows is None:
            return None
        last = days.groupBy(*_KEY).agg(F.max("_seg").alias("_last"))
        seen = rows.join(last, [rows[c].eqNullSafe(last[c]) for c in _KEY], "left").filter(F.col("_last").isNull() | (F.col("_seg") >= F.col("_last")))
        return seen.select(*[rows[c] for c in rows.columns if c != "_seg"])

    def read(self, table: str) -> DataFrame:
        """The rows of a table as of now."""
        rows = self._visible(self.segments(), table)
        if rows is None:
            raise LookupError(f"no table {table!r} in {self.root}")
        return rows

    def replace(self, tables: Mapping[str, DataFrame]) -> int:
        """Replace all rows, in every table of the store, of the user-days that occur in ``tables``; returns the new version.

        A table that is not named loses those user-days as well.
        """
        version, segments, name = self._version(), self.segments(), uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(self._at(name, table))
        days = reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(name, t)).select(*_KEY) for t in tables])
        days.distinct().write.parquet(self._at(name, "_days"))
        return self._publish(version + 1, [*segments, name])

    def compact(self, tables: list[str]) -> int:
        """Write the visible rows as one segment; returns the new version. Older segments stay until they are removed by hand."""
        version, segments, name = self._version(), self.segments(), uuid.uuid4().hex
        for table in tables:
            rows = self._visible(segments, table)
            if rows is not None:
                rows.write.parquet(self._at(name, table))
        self._held(segments, "_days").select(*_KEY).limit(0).write.parquet(self._at(name, "_days"))
        return self._publish(version + 1, [name])
