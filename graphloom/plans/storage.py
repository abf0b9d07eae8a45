"""Tables in the folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is named (as in
    tests on one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("graphloom.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  Unlike cached blocks, this survives lost
    executors, and later plans start from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path  # noqa: SLF001
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of a query; what is there goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in hash partitions of ``keys``, kept on the executors' disks.  Joins on these keys need not
    shuffle it again, as they would if it were read back from files.  What a lost executor held is made
    again.  The number of partitions is fixed, so that adaptive execution leaves it alone."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).persist(StorageLevel.DISK_ONLY)


def drop_written(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_graphloom_path", None)
        if path:
            remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
