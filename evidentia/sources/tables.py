"""Intermediate tables in the folder that all executors share: written once, read back, deleted when nothing reads them."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not deleted yet, with what deletes them.
_held: dict[str, Callable[[], None]] = {}
PREFIX = "evidentia-"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of its own, which is set for the session; a cluster raises."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='evidentia-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the shared one; it goes when the process ends, if not before."""
    path = f"{shared_dir(spark)}/{PREFIX}{uuid.uuid4().hex}"
    _held[path] = functools.partial(_delete, spark, path)
    return path


def drop(path: str) -> None:
    """Delete a scratch() folder."""
    if (delete := _held.pop(path, None)) is not None:
        delete()


def materialize(df: DataFrame) -> DataFrame:
    """Write rows that several parts of a plan read, and read them back: they are computed once, lineage ends here,
    they survive lost executors, and the planner knows their true size. A failed write leaves nothing."""
    path = scratch(df.sparkSession)
    try:
        df.write.parquet(path)
    except BaseException:
        drop(path)
        raise
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    """The scratch folders whose files a plan reads."""
    return {base for base in _held for f in df.inputFiles() if f"/{base.rpartition('/')[2]}/" in f}


def release(*tables: DataFrame) -> None:
    """Delete the intermediate tables that these plans read; call it once their rows have been used."""
    for path in set().union(*map(_folders, tables)):
        drop(path)


def tidy(operator: Callable) -> Callable:
    """An operator that fails leaves none of the intermediate tables it wrote."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        before = set(_held)
        try:
            return operator(*args, **kwargs)
        except BaseException:
            for path in set(_held) - before:
                drop(path)
            raise

    return run


@atexit.register
def _end() -> None:
    for path in list(_held):
        try:
            drop(path)
        except Exception:  # noqa: BLE001 -- the session may be gone, and its shared folder is the cluster's to empty
            break
