"""Outputs that readers see whole or not at all: written aside, checked, and put in place by a rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def publish(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """Let `write` fill a new folder beside `path`, let `check` read it if given, and rename it to `path`; what was there goes after that.

    If writing or checking fails nothing has changed; if the rename fails the old output is put back. Readers find the old output, the new one or, between two renames of
    a folder that is replaced, none; never half of one. The names aside begin with an underscore, which Spark's readers of the folder above pass over.
    """
    jvm, path = spark.sparkContext._jvm, path.rstrip("/")
    above, _, name = path.rpartition("/")
    aside, before = (f"{above}/_{name}-{kind}-{uuid.uuid4().hex}" if above else f"_{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, before))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(aside)
        if check is not None:
            check(aside)
        held = files.exists(at)
        if held and not files.rename(at, old):
            raise OSError(f"{path} could not be moved aside")
        try:
            if not files.rename(new, at):
                raise OSError(f"{path} could not be put in place")
        except BaseException:
            if held:
                files.rename(old, at)
            raise
        if held:
            files.delete(old, True)
    finally:
        files.delete(new, True)
