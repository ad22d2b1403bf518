"""Where the queries of this package register."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def whole_text(docs: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs["text"], F.lit(""))


#: Rows of an Arrow batch; whole texts make rows large, and a batch is held on both sides of a worker.
BATCH_ROWS = 1_000


def small_batches(docs: DataFrame) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows, unless they are smaller already."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def packed(docs: DataFrame) -> DataFrame:
    """text and ``row``, a struct of all other columns: whatever they are called, they meet no column of an operator."""
    small_batches(docs)
    return docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def parallel(df: DataFrame) -> int:
    """How many partitions a heavy step should have."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def per_process(owner: str, key: object, make: Callable[[], Any]) -> Any:
    """One value per worker process. Functions travel by value, so their globals are new in every task; Spark keeps the
    processes, and what one task has loaded or learned serves the next. A new owner drops what others have left."""
    kept = sys.modules.setdefault("_duoscope_process", ModuleType("_duoscope_process")).__dict__
    if kept.get("owner") != owner:
        kept.update(owner=owner, values={})
        give_back()
    values = kept["values"]
    if key not in values:
        values[key] = make()
    return values[key]


def give_back() -> None:
    """Returns to the system what a worker no longer uses: freed memory stays with Arrow's pool and the C library otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def few_rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is computed for one of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
