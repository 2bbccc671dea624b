"""Versions of a folder of tables: what belongs to a version is a few rows, and a version is there or it is not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Versions:
    """A version is one file of rows, put into the manifest by the one rename with which a Spark job ends. Readers take
    the last version they find and keep it: later ones add files and change none. There is one writer at a time; one that
    started from a version that is no longer the last is refused."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, f"{root.rstrip('/')}/manifest", f"v long, {schema}"

    def rows(self, version: int | None = None) -> tuple[int, list[Row]]:
        """(version, its rows) of a version or the last one; a row for each file set, so few. (0, []) before the first."""
        try:
            found = self.spark.read.schema(self.schema).parquet(self.folder)
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return 0, []
            raise
        wanted = F.broadcast(found.agg(F.max("v").alias("v"))) if version is None else None  # one row
        rows = (found.join(wanted, "v") if wanted is not None else found.where(F.col("v") == version)).collect()
        return (rows[0].v if rows else version or 0), rows

    def commit(self, base: int, rows: Sequence[tuple]) -> int:
        """Makes the version after base of these rows."""
        last, _ = self.rows()
        if last != base:
            raise Conflict(f"version {last} is there, this change began at {base}")
        self.spark.createDataFrame([(base + 1, *r) for r in rows], self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        return base + 1
