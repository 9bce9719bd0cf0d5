"""Differences of snapshots: added, changed, removed and reused files, renames, deltas, and publication of a next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state, old_sha256, sha256) of two tables (path, sha256)."""
    old = previous.select("path", F.col("sha256").alias("old_sha256"))
    both = old.join(current.select("path", "sha256"), "path", "full_outer")
    state = F.when(F.col("old_sha256").isNull(), "added").when(F.col("sha256").isNull(), "removed").when(F.col("old_sha256") == F.col("sha256"), "reused").otherwise("changed")
    return both.select("path", state.alias("state"), "old_sha256", "sha256")


def classify_deltas(diff: DataFrame) -> DataFrame:
    """(kind, old_path, path, digest): a removed and an added file with the same digest are a rename if they are the only ones; else ambiguous, one row a digest."""
    removed = diff.where("state = 'removed'").groupBy(F.col("old_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n_old"), F.min("path").alias("old_path"))
    added = diff.where("state = 'added'").groupBy(F.col("sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n_new"), F.min("path").alias("path"))
    both = removed.join(added, "digest")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    none = F.lit(None).cast("string")
    renames = both.where(single).select(F.lit("rename").alias("kind"), "old_path", "path", "digest")
    unclear = both.where(~single).select(F.lit("ambiguous").alias("kind"), none.alias("old_path"), none.alias("path"), "digest")
    paired = both.select("digest")
    gone = diff.where("state = 'removed'").withColumnRenamed("old_sha256", "digest").join(paired, "digest", "left_anti").select(F.lit("delete").alias("kind"), F.col("path").alias("old_path"), none.alias("path"), "digest")
    new = diff.where("state = 'added'").drop("old_sha256").withColumnRenamed("sha256", "digest").join(paired, "digest", "left_anti").select(F.lit("create").alias("kind"), none.alias("old_path"), "path", "digest")
    other = diff.where("state = 'changed'").select(F.lit("change").alias("kind"), F.col("path").alias("old_path"), "path", F.col("sha256").alias("digest"))
    return renames.unionByName(unclear).unionByName(gone).unionByName(new).unionByName(other)


def snapshot_digest(rows: DataFrame, path: str = "path", sha: str = "sha256", parts: int = 256) -> DataFrame:
    """One row: number of files, and a SHA-256 of the digests of `parts` ranges, each the SHA-256 of its files' lines (path, NUL, digest) in order of path.

    Ranges go by the hash of the path, so no task holds all files; the digest depends on neither order nor partitions.
    """
    line = F.concat_ws("\u0000", path, sha)
    ranges = rows.groupBy(F.pmod(F.crc32(F.encode(path, "UTF-8")), F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    ranges = ranges.select("files", F.struct("part", F.sha2(F.encode("lines", "UTF-8"), 256).alias("digest")).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.concat_ws(":", d["part"].cast("string"), d["digest"])), "\n")
    return ranges.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest"))


def apply_changes(previous: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The next snapshot: previous rows without changed and removed paths, and the changed rows. Columns of both are the same."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    return previous.join(gone, "path", "left_anti").unionByName(changed)


def evict(entries: DataFrame, now: int, max_age: int, max_entries: int, max_bytes: int) -> DataFrame:
    """Entries (id, created, bytes) that stay: younger than max_age, then the newest within the bounds.

    Bounds of a store are small, so a top-k cut comes before the running total.
    """
    young = entries.where(F.lit(now) - F.col("created") < max_age)
    order = [F.desc("created"), F.asc("id")]
    newest = young.orderBy(*order).limit(max_entries)
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return newest.withColumn("kept_bytes", F.sum("bytes").over(window)).where(F.col("kept_bytes") <= max_bytes).drop("kept_bytes")


def ranking_differences(recorded: DataFrame, current: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """(keys, change) of two rankings: added, removed or changed rows."""
    old = recorded.select(*keys, F.struct(*payload).alias("old"))
    both = old.join(current.select(*keys, F.struct(*payload).alias("new")), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")
