"""Tables kept between steps in the folder that driver and executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written and not yet deleted, in order.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir. Only a local session, as in tests, may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at, deleted by the `scratch` it is made in."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet and read back, so that what follows reads files instead of computing df once a use."""
    path = new_folder(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table up to which it is dealt out to all cores by a shuffle.
SPREAD_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly if they were read in fewer pieces than the session has cores and are SPREAD_BYTES at most: small tables in one file."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SPREAD_BYTES else rows


#: Bytes of a narrow table, as its files hold it, that a piece of dealt() has at most.
PIECE_BYTES = 4 << 20


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows of a narrow table of any size, dealt out by a hash of their key, in as many pieces a core as PIECE_BYTES asks for.

    One task reads a row group, and a file may be one, into however many pieces it is cut; what follows is to be shared by all cores.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores * max(1, math.ceil(size / (cores * PIECE_BYTES))), key)


def _path(spark: SparkSession, path: str):
    """The Hadoop file system of path, and its path there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def make(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Move a folder; whether there was one."""
    files, at = _path(spark, path)
    return files.exists(at) and files.rename(at, _path(spark, to)[1])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was stored inside; results must have been written or collected by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            delete(spark, _WRITTEN.pop())
