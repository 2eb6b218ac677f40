"""Shared helpers of the text operators: shared storage, word rules, input checks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder, shared_dir, written

#: Space and the five ASCII control separators: the only characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def input_bytes(df: DataFrame, text: str) -> int:
    """About the bytes of a table's texts: Spark's estimate from the files, which reads no rows, or where there is none a sum over all rows."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 58 else df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


#: Bytes up to which a written table is sent to every task; more is joined by an exchange.
SENT_BYTES = 48_000_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if its rows have at most ``SENT_BYTES`` in memory: a sum over all of them."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in keys.dtypes]
    total = keys.agg(F.sum(sum(sizes, F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(keys) if total <= SENT_BYTES else keys


#: Rows that Python code looks at together; texts are long.
BATCH_ROWS = 1000


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``BATCH_ROWS`` at most; a slice copies nothing."""
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(low, BATCH_ROWS)


#: How a column of the caller's is renamed while an operator's own columns stand beside it.
_MINE = "caller__"


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """A table whose columns are all called otherwise than an operator's own ones, and their new names, in order."""
    names = [f"{_MINE}{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end: workers live on, idle, beside other stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(small_batches(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()  # Arrow's own allocator keeps the batches' memory otherwise
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: nothing to ask for

    return wrapped


def words(text: Column) -> Column:
    """The words of a text (maximal runs of other characters than the six separators); null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


__all__ = ["BATCH_ROWS", "SENT_BYTES", "SPACES", "SPACE_CLASS", "input_bytes", "new_folder", "released", "renamed", "sent_if_small", "shared_dir", "small_batches", "words", "written"]
