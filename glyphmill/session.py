"""Session helpers: a local session for tests and benches, and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glyphmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a temporary one is set, but only for a
    local master: executors on other machines would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def ship_package(spark: SparkSession) -> None:
    """Sends the package to executors that don't have it, once a session."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or getattr(sc, "_glyphmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="glyphmill-")) / "glyphmill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._glyphmill_shipped = True


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_table(spark: SparkSession, path: str) -> None:
    target, files = hadoop_path(spark, path)
    files.delete(target, True)


@contextmanager
def free_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted as soon as each write is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted on leaving; what reads them must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete_table(spark, path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table outlives any executor, so later stages never recompute what came before, and columns that a later
    reader doesn't need aren't read. Its shuffle files go at once, the table with the ``scratch`` it was made in, or when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill-{name}-{uuid.uuid4().hex}"
    with free_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    target, files = hadoop_path(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows to as many tasks as shuffles have partitions.

    Adaptive execution merges the partitions of a small shuffle; where each of its rows then costs much work (cutting a
    word into substrings, segmenting it), that work would run in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
