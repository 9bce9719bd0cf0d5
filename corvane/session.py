"""Session helpers: shared checkpoint folder, size checks for broadcasts, table access."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Sides under this many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def builder(cpus: int | str = 8, name: str = "corvane") -> SparkSession.Builder:
    """The builder of a local session with the settings that tests and benches share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's checkpoint folder. A session that names none gets one of this machine if it runs here alone, else it is refused: executors couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-"))


def free_name(columns: list[str], base: str) -> str:
    """A name that none of the columns has, case aside."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system when the application ends."""
    atexit.register(_remove, spark, path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends here and survives lost executors.

    Columnar files are a tenth of a checkpoint's size and give the planner their statistics. They go when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same rows as by `cut` with their number, which the writing job counts."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def cut_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same rows from a table in the shared folder whose files are dealt by the hash of `key` into n buckets: joins and groupings by it read their own bucket, without a shuffle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"corvane_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{name}"
    df.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    remove_at_exit(spark, path)
    return spark.table(name)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end of the application the JVM may be gone
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fingerprint(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What the files of tables are: times, bytes and numbers of files, as the file system tells; contents aren't read and no job runs."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(conf)
        summary = system.getContentSummary(path)
        found.append((name, system.getFileStatus(path).getModificationTime(), summary.getLength(), summary.getFileCount()))
    return sf_dir, *found


_REMEMBERED: dict[tuple, object] = {}


def remembered(spark: SparkSession, key: tuple, build: Callable[[], object]) -> object:
    """What `build` makes, once an application and key; keys hold fingerprints of the tables that it is made from, so changed tables are read again."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _REMEMBERED:
        _REMEMBERED[whole] = build()
    return _REMEMBERED[whole]


def broadcast_if_small(df: DataFrame, n_bytes: int | None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the measured size is known and under the limit."""
    return F.broadcast(df) if n_bytes is not None and n_bytes <= limit else df


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python, once a context, and keeps Arrow batches small unless the session says otherwise.

    Batches cut by bytes bound what a task holds outside the heap, however long the texts are.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_BYTES, None) in (None, "64MB", "67108864b", "67108864"):
        spark.conf.set(_ARROW_BYTES, "4m")
    if not getattr(sc, "_corvane_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._corvane_shipped = True
    return spark
