"""Structured Streaming: windows over events (an extension), and incremental snapshots by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental


def windowed(events: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total), the same for a table and a stream; a stream needs the lateness it waits for."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n) of each user's runs of events."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_of(spark: SparkSession, folder: str, schema, glob: str = "*") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


class SnapshotPublisher:
    """Keeps a versioned snapshot: each batch of changed files makes the next version; a batch that comes again changes nothing.

    Versions are folders below `target`; the last one whose success mark is there is the published one, so a batch that fails keeps the snapshot before.
    """

    def __init__(self, target: str) -> None:
        self.target = target

    def _published(self, spark: SparkSession) -> list[int]:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.target}/{n}/_SUCCESS")))

    def current(self, spark: SparkSession) -> DataFrame | None:
        """The published snapshot, None before the first."""
        versions = self._published(spark)
        return spark.read.parquet(f"{self.target}/v{versions[-1]}") if versions else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Upserts (path, sha256, text, removed) rows; the last row of a path in a batch wins by sha256."""
        spark = batch.sparkSession
        if batch_id in self._published(spark):
            return
        last = batch.groupBy("path").agg(F.max_by(F.struct("sha256", "text", "removed"), F.struct("removed", "sha256")).alias("r")).select("path", "r.*")
        changed = last.where("not removed").select("path", "sha256", "text")
        before = self.current(spark)
        after = changed if before is None else incremental.apply_changes(before, changed, last.where("removed").select("path"))
        after.write.mode("overwrite").parquet(f"{self.target}/v{batch_id}")

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over all changes that are there and ends."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
