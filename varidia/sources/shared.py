"""Tables in the folder that driver and executors share.

What a caller is done with can be removed; tables that a returned DataFrame reads stay until the Python process ends, and then go.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one, a temporary folder serves a local master (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"file://{mkdtemp(prefix='varidia-')}"
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the process."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    return written(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def leftover() -> list[str]:
    """The tables that are still there."""
    return list(_left)


@atexit.register
def _clean() -> None:
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            removed(spark, path)
