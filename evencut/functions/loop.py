"""Cutting lineage with tables in the folder that the driver and all executors share.

The tables of a loop go as soon as they are replaced; what a returned DataFrame may still read goes with
drop_tables(), which also runs at the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}  # by application: the folder of a local session that names none
_made: dict[str, tuple] = {}  # tables that exist: file system and path of each


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a folder of this process, which only a local master can use."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="evencut-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/evencut/{tag}-{uuid.uuid4().hex}"


def _keep(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = (at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def drop_path(path: str) -> None:
    if path in _made:
        files, at = _made.pop(path)
        files.delete(at, True)


def drop_tables() -> None:
    """Deletes all tables that materialize and loops of this process made; DataFrames that read them can't be read after that."""
    for path in list(_made):
        drop_path(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone, and the shared folder with it
        drop_tables()


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: the plan starts anew, and a lost executor costs one read."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    _write(spark, df, path)
    return spark.read.schema(df.schema).parquet(path)


def _write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes df; its shuffle files go with the job, not with the driver's next garbage collection."""
    _keep(spark, path)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)


def settle(make, tag: str) -> DataFrame:
    """materialize(make()); the tables that make() left behind go."""
    before = set(_made)
    out = materialize(make(), tag)
    newest = next(reversed(_made))
    for path in [p for p in _made if p not in before and p != newest]:
        drop_path(path)
    return out


class Loop:
    """Keeps the newest table of each name of an iteration and deletes those it replaced."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, name)
        _write(self.spark, df, path)
        old = self.paths.pop(name, [])
        for p in old[:-1]:
            drop_path(p)
        self.paths[name] = [*old[-1:], path]
        return self.spark.read.schema(df.schema).parquet(path)
