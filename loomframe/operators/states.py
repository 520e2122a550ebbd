"""Latest states that are kept and merged into, not worked out anew from all events.

A state table is dealt to buckets by its key. A batch of events becomes partial states (one row a key); they are merged with the old
rows of the buckets that they touch, and those buckets alone are written, as a new version. Partial states merge like the
aggregates they come from (greatest and least), so batches may come in any order, and one that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.operators import lifecycle, sessions
from loomframe.sources.versions import KEEP, Versions

BUCKETS = 64


class StateTable:
    """State at path of rows told apart by key; merge makes one row for each key of rows that have the columns of states."""

    def __init__(self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.versions, self.key, self.merge, self.buckets = Versions(spark, path, ("state",), ["bucket"]), key, merge, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string"))

    def read(self) -> DataFrame:
        return self.versions.read()["state"].drop("bucket")

    def lookup(self, *values) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        own = self.versions.read()["state"]
        kind = own.schema[self.key].dataType
        at = [F.pmod(F.xxhash64(F.lit(v).cast(kind)), F.lit(self.buckets)).cast("string") for v in values]
        return own.filter(F.col("bucket").isin(*at) & F.col(self.key).isin(*values)).drop("bucket")

    def update(self, batch: DataFrame) -> int | None:
        """Merges a batch of partial states; rows without a key are left out. The number of the new version; None for an empty batch."""
        new = self._dealt(self.merge(batch.filter(F.col(self.key).isNotNull())))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # one row a bucket at most
        if not touched:
            return None
        if self.versions.numbers():
            old = self.versions.read()["state"].filter(F.col("bucket").isin(touched))
            new = self._dealt(self.merge(old.drop("bucket").unionByName(new.drop("bucket"))))
        groups = batch.sparkSession.createDataFrame([(b,) for b in touched], "bucket string")
        number = self.versions.write({"state": new}, groups)
        self.versions.clear(KEEP)
        return number


def session_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StateTable:
    """Sessions: update() with sessions.session_partials of a batch, sessions.finished_sessions of read()."""
    return StateTable(spark, path, "session_id", sessions.merged_partials, buckets)


def document_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StateTable:
    """Documents: update() with lifecycle.status_partials of a batch, lifecycle.finished_status of read()."""
    return StateTable(spark, path, "doc_id", lifecycle.merged_status, buckets)
