"""Intermediate tables in the folder that all executors see (spark.checkpoint.dir), and small files put there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: While it is on, Spark deletes the shuffle files of a write when the write has ended, otherwise once the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a private folder only where none is set and everything runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracelake-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes in here leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df and read it back: cuts lineage, survives lost executors.  free: the shuffle files of the write go with its end."""
    path = new_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession) if free else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Write one small file."""
    system, target = _folder(spark, path)
    out = system.create(target, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def listed(spark: SparkSession, path: str, suffix: str = "") -> dict[str, str]:
    """File name to content of the files in a folder (a handful of configuration files); none where there is no folder."""
    system, target = _folder(spark, path)
    if not system.exists(target):
        return {}
    names = [f.getPath() for f in system.listStatus(target) if f.isFile()]
    utils = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    out = {}
    for own in names:
        if own.getName().endswith(suffix):
            stream = system.open(own)
            out[own.getName()] = utils.toString(stream, "UTF-8")
            stream.close()
    return out


def release() -> None:
    """Delete what was written so far (also done when Python ends)."""
    while _written:
        spark, path = _written.pop()
        try:
            system, target = _folder(spark, path)
            system.delete(target, True)
        except Exception:  # the session has ended: nothing can be deleted through it
            continue


atexit.register(release)
