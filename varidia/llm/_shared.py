"""Tables and cut lineage in the folder that driver and executors share.

Operators remove the tables that only they read. Those that a returned DataFrame reads stay until the Python process
ends: then all that are left are removed.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set and all runs in one JVM (tests), a temporary one becomes it; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; later reads survive lost executors."""
    return written(df, "cut")[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def leftover() -> list[str]:
    """The tables that are still there: those that DataFrames which were returned may read."""
    return list(_left)


@atexit.register
def _clean() -> None:
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            removed(spark, path)
