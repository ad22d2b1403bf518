"""Token ids in patched frame-of-reference blocks.

A block holds ``BLOCK`` ids. Its smallest id is subtracted, the rest is packed at the width that ``PERCENTILE`` of its
values fit into, and values that need more bits go to an exception list (position, value). A shard is a run of whole
documents: a header, the document lengths, one index entry per block (start, minimum, width, exceptions), the packed words
and the exceptions. Shards are rows of a written table, sorted by ``doc_id``, so that writing follows Spark's commit
protocol and works on every file system Spark knows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.llm.registry import parallel, per_process, query, small_batches, whole_text
from duoscope.session import scratch_path, table

BLOCK = 256
LANES = BLOCK // 32
PERCENTILE = 0.9
SHARD_TOKENS = 1 << 18
#: Distinct pieces a worker process remembers besides those of one slice; above it, the half last used stays.
CACHE_PIECES = 300_000
#: Pieces learned in one call, which bounds what the tokenizer holds at once.
LEARN_PIECES = 20_000
MAGIC = 0x50464F52
MARKS = np.frombuffer(b",.", np.uint8)
#: Bytes of texts encoded at once; a longer text is encoded alone. The larger, the fewer distinct pieces are looked up, and the more
#: memory a worker takes: 10 MB at once took 1.8 times the memory of 2 MB, and let the piece cache grow by all pieces of a slice.
SLICE_BYTES = 2 << 20
SHARD_SCHEMA = "part int, seq int, start_in_part long, n_tokens long, doc_ids array<bigint>, payload binary"
DOC_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------------------------------------ block codec
def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values at ``width`` bits: value 8j+l of a block goes to lane l, place j."""
    places = np.ascontiguousarray(rows.reshape(len(rows), 32, LANES).transpose(1, 0, 2))
    out = np.zeros((width, len(rows), LANES), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[word] |= places[j] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= places[j] >> np.uint32(32 - shift)
    return out.transpose(1, 0, 2).reshape(len(rows), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(len(words), width, LANES).transpose(1, 0, 2))
    out = np.empty((32, len(words), LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        value = lanes[word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | lanes[word + 1] << np.uint32(32 - shift)
        out[j] = value & mask
    return out.transpose(1, 0, 2).reshape(len(words), BLOCK)


def encode_shard(ids: np.ndarray, doc_lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One shard: ``ids`` (uint32) of documents with the given lengths."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    blocks = np.resize(ids[-1:] if n else ids, n_blocks * BLOCK).astype(np.uint32)
    blocks[:n] = ids
    blocks = blocks.reshape(n_blocks, BLOCK)
    low = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    edge = np.partition(rest, at, axis=1)[:, at] if n_blocks else np.zeros(0, np.uint32)
    width = np.frexp(edge.astype(np.float64))[1].astype(np.uint8)  # bits of the percentile's value
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    row, col = np.nonzero(over)
    values = rest[row, col]
    rest[over] = 0
    starts = np.zeros(n_blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * LANES, out=starts[1:])
    words = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(width):
        if w:
            sel = np.nonzero(width == w)[0]
            words[starts[sel][:, None] + np.arange(int(w) * LANES, dtype=np.uint32)] = _pack(rest[sel], int(w))
    exceptions = over.sum(axis=1).astype("<u2")
    head = np.array([MAGIC, len(doc_lengths), n, n_blocks, len(words), len(values)], "<u4")
    return b"".join(x.tobytes() for x in (
        head, doc_lengths.astype("<u4"), starts.astype("<u4"), low.astype("<u4"), width, exceptions, words.astype("<u4"),
        col.astype(np.uint8), values.astype("<u4")))


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and document lengths of a shard."""
    magic, n_docs, n, n_blocks, n_words, n_values = np.frombuffer(data, "<u4", 6).tolist()
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    lengths, starts, low = take("<u4", n_docs), take("<u4", n_blocks + 1), take("<u4", n_blocks)
    width, exceptions, words = take("u1", n_blocks), take("<u2", n_blocks), take("<u4", n_words)
    col, values = take("u1", n_values), take("<u4", n_values)
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            sel = np.nonzero(width == w)[0]
            out[sel] = _unpack(words[starts[sel][:, None] + np.arange(int(w) * LANES, dtype=np.uint32)], int(w))
    out[np.repeat(np.arange(n_blocks), exceptions), col] = values
    out += low[:, None]
    return out.reshape(-1)[:n], lengths


# ------------------------------------------------------------------------------------------------ tokenizing
#: Texts that are not cut at blanks: empty ones, runs of white space, other white space.
WHOLE = ("^$|^[ \\n]|[ \\n]$|[ \\n][ \\n]|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
         "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


class PieceEncoder:
    """Token ids of texts as little-endian bytes, each distinct piece encoded once.

    The tokenizer's pattern always starts a new token at a single space or newline between other characters, and at a comma
    or full stop after a letter, so a text may be cut there and its pieces encoded alone. Texts with runs of white space,
    other white space or the name of a special token are encoded whole. Cutting, looking pieces up and putting ids together
    go by whole columns; the pieces known are one column too, as a dictionary of strings takes several times the memory.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.turn = Tokenizer.from_file(path), limit, 0
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([WHOLE, *names])
        # the pieces known, the first of which stays; their ids, where those start, and the turn of their last use
        self.known, self.ids = pa.array(["\n"], pa.large_string()), self._ids("\n")
        self.starts, self.used = np.array([0, len(self.ids)]), np.array([np.iinfo(np.int64).max])

    def _ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.fromiter(found, "<u4", len(found))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Adds distinct pieces that are not known. Returns their places."""
        blank = pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
        order = np.argsort(~blank, kind="stable")
        ids, sizes, n = [self.ids], [np.diff(self.starts)], len(self.known)
        first, others = (new.take(pa.array(x)) for x in np.split(order, [blank.sum()]))
        # many in one text: a token that starts with a blank is where the next piece starts, else line breaks are between pieces
        for at in range(0, len(first), LEARN_PIECES):
            offsets, data = characters(first.slice(at, LEARN_PIECES))
            ids.append(self._ids(str(data[offsets[0]:offsets[-1]], "utf-8")))
            sizes.append(np.diff(np.flatnonzero(self.blank[ids[-1]]), append=len(ids[-1])))
        for at in range(0, len(others), LEARN_PIECES):
            some = self._ids("\n".join(others.slice(at, LEARN_PIECES).to_pylist()))
            cuts = some == self.ids[0]
            ids.append(some[~cuts])
            sizes.append(np.diff(np.flatnonzero(cuts), prepend=-1, append=len(some)) - 1)
        self.known = pa.concat_arrays([self.known, first, others])
        self.ids, self.starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        if len(self.known) != len(self.starts) - 1 or self.starts[-1] != len(self.ids):
            raise ValueError("the tokenizer does not start tokens where pieces are cut")
        places = np.empty(len(new), np.int64)
        places[order] = np.arange(n, n + len(new))
        return places

    def _forget(self) -> None:
        """Keeps the half last used once there are more than the limit."""
        if len(self.known) > self.limit:
            stay = np.sort(np.argpartition(-self.used, self.limit // 2)[:max(1, self.limit // 2)])
            sizes = np.diff(self.starts)
            kept = np.zeros(len(sizes), bool)
            kept[stay] = True
            self.ids = self.ids[np.repeat(kept, sizes)]
            self.starts = np.concatenate([[0], np.cumsum(sizes[stay])])
            self.known, self.used = self.known.take(pa.array(stay)), self.used[stay]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the pieces are among those known; new ones are learned."""
        self._forget()
        places = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        lost = np.flatnonzero(places < 0)
        if len(lost):
            new = pieces.take(pa.array(lost)).dictionary_encode()
            places = places.copy()
            places[lost] = self._learn(new.dictionary)[new.indices.to_numpy()]
        self.turn += 1
        self.used[places] = np.maximum(self.used[places], self.turn)
        return places

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        for i in np.flatnonzero(whole):
            out[i] = self._ids(column[int(i)].as_py()).tobytes()
        at = np.flatnonzero(~whole)
        if len(at):
            texts, data = characters(column.take(pa.array(at)))
            cuts = cut(texts, data)
            places = self._places(pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)))
            kind = np.int32 if len(data) < 1 << 30 else np.int64  # no text has more ids than bytes
            count = np.diff(self.starts).astype(kind)[places]
            ends = np.zeros(len(cuts), kind)
            np.cumsum(count, out=ends[1:])
            from_place = np.repeat(self.starts.astype(kind)[places] - ends[:-1], count)
            from_place += np.arange(ends[-1], dtype=kind)
            joined = self.ids[from_place].tobytes()
            stops = 4 * ends[np.searchsorted(cuts, texts)].astype(np.int64)
            for i, a, b in zip(at.tolist(), stops[:-1].tolist(), stops[1:].tolist()):
                out[i] = joined[a:b]
        return out


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The borders of the texts of a column without nulls, and its bytes."""
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1], np.frombuffer(data, np.uint8)


def cut(texts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Borders of the pieces: those of the texts, before blanks, around line breaks, and before marks after ASCII letters."""
    starts = (data == 32) | (data == 10)
    starts[1:] |= data[:-1] == 10
    lower = data[:-1] | 32
    starts[1:] |= np.isin(data[1:], MARKS) & (lower >= 97) & (lower <= 122)
    starts[texts[:-1]] = True
    return np.append(np.flatnonzero(starts[:texts[-1]]), texts[-1])


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of about ``size`` bytes, across Arrow batches."""
    held: list[pa.RecordBatch] = []
    length = 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(lengths[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(lengths, before + size - length, side="right")))
            held.append(batch.slice(at, stop - at))
            length += int(lengths[stop - 1]) - before
            at = stop
            if length >= size or at < batch.num_rows:
                yield _together(held)
                held, length = [], 0
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    return rows["doc_id"].to_pylist(), pa.concat_arrays(rows["text"].chunks)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every text, each ended by ``end_id``, as shards in ascending doc_id order.

    Null texts count as empty; rows without doc_id come first; rows with the same doc_id are ordered by a hash of the text.
    Memory per task: one Arrow batch of texts, one shard (more only where a single text is longer); per worker process
    the piece cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process("tokens", tokenizer_path, lambda: PieceEncoder(tokenizer_path))
        end = np.array([end_id], "<u4").tobytes()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        lengths: list[int] = []
        names: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            payload = encode_shard(np.frombuffer(b"".join(ids), "<u4"), np.array(lengths, np.uint32))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()),
                pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "seq", "start_in_part", "n_tokens", "doc_ids", "payload"])

        for doc_ids, texts in slices(batches):
            for name, got in zip(doc_ids, encoder.encode(texts), strict=True):
                ids += (got, end)
                lengths.append(len(got) // 4 + 1)
                names.append(name)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield shard()
                    seq, start, held = seq + 1, start + held, 0
                    ids, lengths, names = [], [], []
        if names:
            yield shard()

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parallel(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    rows.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the written shards: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths = decode_shard(batch["payload"][k].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_ids"][k].values, pa.array(np.full(n, batch["part"][k].as_py(), np.int32)),
                    pa.array(batch["start_in_part"][k].as_py() + ends - lengths), pa.array(lengths.astype(np.int64)),
                    pa.array(crcs, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written part, as many as the writing job had tasks
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = per_part.select("part", before.alias("offset"))
    docs = shards.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(run, DOC_SCHEMA)
    return docs.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the shards into the shared folder and reads them back. No documents: no rows."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer_path)
    return read_shards(docs.sparkSession, path)


@query("op1_token_blocks")
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
