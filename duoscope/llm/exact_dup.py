"""Exact duplicates by an extendible-hash index in the shared folder.

Every text gets a 64-bit key. The directory starts as one bucket; a bucket with more than ``CAPACITY`` keys is split by its
next bits, and the directory doubles as often as its deepest bucket needs. Buckets are ranges of keys; each is owned by one
task. Sending tasks pass on each distinct text they hold once, however many rows have it; owners chain the different texts
of a key by comparing bytes and write the entries of their buckets as index files. Documents look their entry up by key and
SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import parallel, query, whole_text
from duoscope.session import collect_bounded, scratch_path, table

#: Keys of a bucket above which it is split.
CAPACITY = 16_384
#: Bits by which an overfull bucket is split at once.
STEP = 4
MAX_BUCKETS = 5_000_000
#: Bytes of distinct texts that a sending task holds before it passes them on.
HOLD_BYTES = 32 << 20
PARTIAL = "bucket long, key long, text binary, sha binary, keep_id long, n long"
ENTRY = "bucket long, key long, place int, sha binary, keep_id long, group_size long"


def directory(keys: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """The first key (as an unsigned number) of every bucket, ascending.

    ``keys`` has distinct keys. A round counts the keys below each overfull bucket only; a bucket is halved until no half of
    it is overfull. Rows for the driver: the sub-buckets of overfull buckets.
    """
    starts, open_buckets, depth = {0}, [0], 0
    while open_buckets and depth < 64:
        depth += STEP
        sub = F.shiftrightunsigned("key", 64 - depth).alias("sub")
        rows = keys.select(sub)
        if depth > STEP:
            above = keys.sparkSession.createDataFrame([(b,) for b in open_buckets], "above long")
            rows = rows.join(above, F.shiftrightunsigned("sub", STEP) == F.col("above"), "left_semi")
        counts = dict(collect_bounded(rows.groupBy("sub").count(), MAX_BUCKETS, "buckets"))
        roots = [0] if depth == STEP else open_buckets
        open_buckets = []
        for root in roots:
            todo = [(root << STEP, STEP)]
            while todo:
                first, bits = todo.pop()
                if sum(counts.get(first + k, 0) for k in range(1 << bits)) <= capacity:
                    continue
                if bits == 0:
                    open_buckets.append(first)
                    continue
                half = 1 << (bits - 1)
                starts.add((first + half) << (64 - depth))
                todo += [(first, bits - 1), (first + half, bits - 1)]
    return np.array(sorted(starts), np.uint64)


def _entries(docs: DataFrame, starts: np.ndarray) -> DataFrame:
    """The index entries of all texts."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array([k for k, _ in held], np.int64)
            buckets = np.searchsorted(starts, keys.view(np.uint64), side="right").astype(np.int64)
            out = list(held.values())
            return pa.RecordBatch.from_arrays([
                pa.array(buckets), pa.array(keys), pa.array([t for _, t in held], pa.binary()),
                pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.int64())], ["bucket", "key", "text", "sha", "keep_id", "n"])

        for batch in batches:
            for doc_id, key, text, sha in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"],
                                              batch["sha"], strict=True):
                raw = text.as_buffer().to_pybytes()
                seen = held.get((key, raw))
                if seen is None:
                    held[key, raw] = [sha.as_py(), doc_id, 1]
                    size += len(raw)
                else:
                    seen[2] += 1
                    if seen[1] is None or doc_id is not None and doc_id > seen[1]:
                        seen[1] = doc_id
                if size > HOLD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the chain of a key holds each of its different texts once."""
        now: tuple[int, int] | None = None
        links: list[list] = []

        def entries() -> pa.RecordBatch:
            n = len(links)
            return pa.RecordBatch.from_arrays([
                pa.array([now[0]] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                pa.array([x[1] for x in links], pa.binary()), pa.array([x[2] for x in links], pa.int64()),
                pa.array([x[3] for x in links], pa.int64())], ["bucket", "key", "place", "sha", "keep_id", "group_size"])

        for batch in batches:
            for row in zip(*(batch[c] for c in ("bucket", "key", "text", "sha", "keep_id", "n")), strict=True):
                bucket, key, text, sha, keep_id, n = (x.as_py() for x in row)
                if now != (bucket, key):
                    if links:
                        yield entries()
                    now, links = (bucket, key), []
                for link in links:
                    if link[0] == text:
                        link[2] = max((x for x in (link[2], keep_id) if x is not None), default=None)
                        link[3] += n
                        break
                else:
                    links.append([text, sha, keep_id, n])
        if links:
            yield entries()

    partial = docs.select("doc_id", "key", "text", "sha").mapInArrow(combine, PARTIAL)
    owned = partial.repartition(parallel(docs), "bucket").sortWithinPartitions("bucket", "key")
    return owned.mapInArrow(chain, ENTRY)


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest doc_id stays; a null doc_id is
    below all others. Rows that repeat both id and text are all marked like the first of them. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).cast("binary").alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256))})
    marks_path, keys_path, index_path = (scratch_path(spark, f"exact-{x}") for x in ("marks", "keys", "index"))
    rows.select("doc_id", "key", "sha").write.parquet(marks_path)
    marks = spark.read.parquet(marks_path)
    marks.select("key").distinct().write.parquet(keys_path)
    starts = directory(spark.read.parquet(keys_path), capacity)
    _entries(rows, starts).write.parquet(index_path)
    index = spark.read.schema(ENTRY).parquet(index_path).select("key", "sha", "keep_id", "group_size")
    found = marks.join(index, ["key", "sha"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op6_exact_dup", OP6_SQL)
def op6_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
