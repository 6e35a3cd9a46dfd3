"""What the operators of this folder share: tables, and data kept between the steps of a job."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import Steps

__all__ = ["SPACES", "Steps", "give_back", "numbered", "remembered", "table", "without"]

#: Bytes that part words, in texts as UTF-8.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, steps: Steps) -> tuple[DataFrame, str]:
    """docs written once with a 64-bit number for each row, and that column's name, which docs does not have.

    Numbers are given while the table is written and are the same for all that read it: ids may be null or repeated.
    """
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return steps.keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


#: Row numbers that are broadcast at most.
NUMBERS = 500_000


def without(rows: DataFrame, row: str, gone: DataFrame, steps: Steps) -> DataFrame:
    """Rows of a numbered table but those whose numbers gone holds, in its column of that name; without the numbers.

    Numbers are written first, so that their count decides: a bounded number goes to where the rows lie, and these are not
    shuffled; more of them meet the rows by a sort and a merge.
    """
    gone = steps.keep(gone, "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= NUMBERS else gone.hint("merge"), row, "left_anti").drop(row)


_REMEMBERED: dict = {}


def give_back() -> None:
    """Memory this process has freed goes back to the system: workers share an executor's, Python shares the driver's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def remembered(key: tuple | None, make=None):
    """What this Python worker keeps from task to task for one operator.

    A worker serves the tasks of many jobs; it keeps one operator's look-up tables at a time, so that those of an
    earlier job take no memory from a later one. A key of None keeps nothing; it is asked for at the start of a task.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        give_back()
        if key is not None:
            _REMEMBERED[key] = make()
    return _REMEMBERED.get(key)
