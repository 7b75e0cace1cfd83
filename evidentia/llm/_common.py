"""What the training-data operators share: table access, the word pattern, durable intermediates."""

from __future__ import annotations

import ctypes
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.tables import drop, materialize, release, tidy

__all__ = ["WORD", "durable", "drop", "forget", "give_back", "n_words", "release", "table", "tidy"]

#: A word, for every operator of this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Write a table once to the shared folder and read it back. A reliable checkpoint() would compute the rows twice.
durable = materialize
#: Delete the durable tables that nothing reads any more.
forget = release


_given_back = 0.0


def give_back(pause: float = 0.2) -> None:
    """In a Python worker: return freed memory to the system, at most once in `pause` seconds. Workers outlive their stage, and so does what they keep."""
    global _given_back
    if time.monotonic() - _given_back < pause:
        return
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    _given_back = time.monotonic()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text, null counted as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
