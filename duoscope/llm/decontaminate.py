"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are sequences of normalised words. The automaton of a block of items accepts exactly the word sequences that occur in
one of them. A document's words are streamed through it while the length of the longest matching suffix is tracked; wherever
that length reaches a window, the window's words are hit. The spans of hit words are removed, and documents too much of
which is hit are dropped.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import packed, per_process, query, unpacked, whole_text
from duoscope.session import scratch_path, table

WINDOW = 10
#: Bytes of item texts in one automaton; more items are handled in more passes over the documents.
BLOCK_BYTES = 4 << 20
#: A document of whose words a larger share is hit is dropped whole.
MAX_COVERAGE = 0.5
KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower-cases A-Z and turns all that is no part of a word into a space, byte for byte.
WORD_BYTES = bytes(c if c in KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; ``windows`` words make a window, shorter items are one window each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab, self.names = window, {}, []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            paths.append(ids)
            self.names.append(name)
        n = len(self.next)
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, ids in enumerate(paths):
            state = 0
            for c in ids:
                state = self.next[state][c]
                if len(ids) >= window:
                    up = state
                    while up > 0 and self.length[up] >= window and k not in self.items[up]:
                        self.items[up].add(k)
                        up = self.link[up]
            if len(ids) < window:
                self.short[state].append((len(ids), k))
        # the nearest state, itself included, on the way to the root that holds a short item
        self.near = [-1] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.near[state] = state if self.short[state] else self.near[self.link[state]]
        self.least = min([window, *(len(ids) for ids in paths)])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that end with p's, one word longer."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of hit words, ascending and disjoint, and the numbers of the items whose windows occur."""
        step, link, length, near = self.next, self.link, self.length, self.near
        state = matched = 0
        window, least = self.window, self.least
        spans: list[list[int]] = []
        items: set[int] = set()
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                state = matched = 0
                continue
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched < least:
                continue
            start = i + 1
            if matched >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                items |= self.items[up]
                start = i + 1 - window
            up = near[state]
            while up > 0:
                for size, k in self.short[up]:
                    if size <= matched:
                        items.add(k)
                        start = min(start, i + 1 - size)
                up = near[link[up]]
            if start <= i:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; other characters stay as they are."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of about ``block_bytes``, chosen by a hash of item and text; only one is on the driver at a time."""
    rows = items.select(F.col("item_id").alias("name"), whole_text(items).alias("text"))
    rows = rows.withColumn("bytes", F.octet_length("text").cast("long"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["name"], words_of(r["text"])) for r in rows.where(F.col("block") == k).select("name", "text").toLocalIterator()]


def find_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (all columns of ``docs`` but text), text and: n_words, spans (hit words as [start, end) in words), items (names as
    strings, one per row of ``items`` that has a window here: two rows of one name are two items, a null name stays null).

    One pass over the documents per block of items; the automaton of a block is broadcast, its size bound by ``block_bytes``
    (a longer item is a block of its own size). Null texts have no words; no items, or items without words, hit nothing.
    """
    sc = docs.sparkSession.sparkContext
    out = packed(docs).select("*", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<a:int,b:int>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for k, block in enumerate(item_blocks(items, block_bytes)):
        if k:
            path = scratch_path(docs.sparkSession, "decontaminate")
            out.write.parquet(path)
            out = docs.sparkSession.read.schema(schema).parquet(path)
        shipped = sc.broadcast(cloudpickle.dumps(SuffixAutomaton(block, window)))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, name=name) -> Iterator[pa.RecordBatch]:
            automaton = per_process(f"decontaminate-{name}", name, lambda: pickle.loads(shipped.value))  # one a process, not one a task
            names = [None if x is None else str(x) for x in automaton.names]
            for batch in batches:
                at = {c: batch.schema.get_field_index(c) for c in ("text", "n_words", "spans", "items")}
                n_words, all_spans, all_items = [], [], []
                for text, before, named in zip(batch.column(at["text"]), batch.column(at["spans"]),
                                               batch.column(at["items"]), strict=True):
                    words = words_of(text.as_py())
                    spans, found = automaton.scan(words)
                    n_words.append(len(words))
                    old = [(s["a"], s["b"]) for s in before.as_py()]
                    all_spans.append([{"a": a, "b": b} for a, b in (_merge([*old, *spans]) if old else spans)])
                    all_items.append(sorted([*named.as_py(), *(names[i] for i in found)], key=lambda x: (x is None, x or "")))
                for c, values in (("n_words", n_words), ("spans", all_spans), ("items", all_items)):
                    batch = batch.set_column(at[c], batch.schema.field(at[c]), pa.array(values, batch.schema.field(at[c]).type))
                yield batch

        out = out.mapInArrow(run, schema)
    return out


def hit_words(spans) -> F.col:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Items without item_id count and hit like others, but have no name to be joined.
    """
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window)
    return found.select(
        "row.doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with hit spans cut out of the texts, without the documents of whose words more than ``max_coverage`` is hit."""
    found = find_spans(docs, items, window)
    share = F.try_divide(hit_words(F.col("spans")), F.col("n_words"))
    found = found.where(F.coalesce(share, F.lit(0.0)) <= max_coverage).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, [(s["a"], s["b"]) for s in spans]) if spans else t
                     for t, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, batch["text"].type)], ["row", "text"])

    cut = found.mapInArrow(run, found.select("row", "text").schema)
    return unpacked(cut, docs.columns)


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
