"""Column helpers and skew-safe joins shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the contracts: a word is a run of anything but these six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# At most this many keys are ever broadcast as hot ones.
HOT_KEYS = 5_000
# A key is never called hot below this many rows.
HOT_ROWS = 20_000
# Bytes of rows in one batch for a Python worker.
BATCH_BYTES = 8 << 20
# Bits of a row's index in its file in the numbers of with_place.
FILE_BITS = 40


def bounded_batches(df: DataFrame) -> None:
    """Lets at most BATCH_BYTES of rows go to a Python worker at once, in this session from now on.

    A batch exists several times over, beside the heap and in the worker; long texts
    would fill Spark's default of 64 MB.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release_memory() -> None:
    """Gives back what earlier operators left in this worker process, which Spark uses again for the next one.

    Called where a task starts in Python: the memory of tokenized chunks and free blocks
    of the allocators would else stand beside what the task itself needs.
    """
    import pyarrow as pa

    tokens = sys.modules.get("hushframe.llm.tokens")
    if tokens is not None:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # only this C library hands free blocks back on request
        pass


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds the row's place in the scan: (partition << 33) + index in it.

    Splits depend on the cores that live when a job starts, so the number holds inside
    one job only: stage it with the rows and read it back.  ``with_place`` gives numbers
    that several scans share.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def with_place(scan: DataFrame, name: str) -> DataFrame:
    """Adds the row's place in its file: (number of the file << FILE_BITS) + index in the file.

    ``scan`` must be a plain scan of files (a table, or a staged frame).  Files are
    numbered in the order of their paths and rows by the reader, so every scan gives a
    row the same number however the files are split.
    """
    path, at, file = fresh(scan, "_path_of_row", "_index_of_row", "_file_of_row")
    # as long as the list of files that the scan itself holds on the driver
    names = sorted(r[0] for r in scan.select("_metadata.file_path").distinct().collect())
    files = scan.sparkSession.createDataFrame(list(zip(names, range(len(names)))), f"`{path}` string, `{file}` long")
    rows = scan.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    known = F.coalesce(F.col(file), F.raise_error(F.concat(F.lit("a file outside the scan's own list: "), F.col(path))).cast("long"))
    return rows.join(F.broadcast(files), path, "left").withColumn(name, F.shiftleft(known, FILE_BITS) + F.col(at)).drop(path, at, file)


def join_hot(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``table`` (one row per key; ``weight``: the key's rows in ``rows``) to ``rows``.

    Keys with more than max(HOT_ROWS, total / HOT_KEYS) rows are fewer than HOT_KEYS:
    they alone are broadcast and their rows stay where they are.  All other keys are
    bounded and go through an ordinary join.
    """
    on = list(on)
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.filter(F.col(weight) > bound)
    if total <= bound or hot.isEmpty():
        return rows.join(table, on, how)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(
        cold.join(table.filter(F.col(weight) <= bound), on, how)
    )
