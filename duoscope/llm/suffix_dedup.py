"""Repeated byte strings by content-defined sampling, hash grouping and byte comparison.

Strings of ``LENGTH`` bytes are judged; no suffix is ordered and no adjacent prefixes are compared, as the difference-cover
algorithm would. The sample is a content-defined cover: within every string of LENGTH bytes the position of the smallest hash of GRAM bytes is
sampled, so equal strings have equal samples (a cover by position, as in the difference-cover algorithm, would have to
sample 24% of all positions for this; this one samples 7%). Steps:

1. the texts are dealt to groups of bounded size, equal texts once;
2. samples whose gram occurs in one text only are dropped (hashes of grams are counted, a shared hash only keeps a sample);
3. the remaining samples, with the bytes around them, are dealt by gram; the strings around a sample are grouped by hash, and
   each is compared with the first of its group, byte by byte, and is marked when a smaller doc_id has it, too;
4. the marks go back to the groups, where the texts are cut.

Equal surroundings within a group are sent once, and strings around grams that occur very often are dealt one by one, so a
gram that a third of all texts hold is no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import query, whole_text
from duoscope.session import scratch_path, table

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM  # bytes a string can start before its sample
AROUND = REACH + LENGTH
#: Bytes of texts per group; bounds the memory of a task.
GROUP_BYTES = 4 << 20
#: Bytes of texts handled at once inside a group; a longer text is handled alone.
SLICE = 1 << 20
#: Occurrences of a gram from which the strings around it are dealt one by one.
OFTEN = 50_000
#: Distinct texts a sending task remembers, so as to send each once.
SEEN = 500_000
LAST = (1 << 63) - 1
TEXTS = "gid long, sha binary, doc_id long, text binary"
GRAMS = "bucket long, gid long, grams binary, counts binary"
SHARED = "gid long, grams binary, often binary"
ENTRIES = "bucket long, gid long, keys binary, docs binary, places binary, limits binary, around binary"
MARKS = "gid long, grams binary, often binary, places binary, marks binary"
CUT = "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
U64, MASK48 = np.uint64, np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _hash_bytes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of bytes."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    out = np.full(len(rows), rows.shape[1], U64)
    for word in padded.view("<u8").T:
        out = _mix(out * U64(0x9E3779B97F4A7C15) + word)
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i + width]."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def samples(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sampled positions of concatenated texts that end at ``ends``, ascending."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    h, size, factor = data.astype(np.uint32) + np.uint32(1), 1, 0x01000193
    parts = []
    for bit in (8, 16):  # 24 = 8 + 16, by doubling
        while size < bit:
            h = h[:-size] * np.uint32(factor) + h[size:]
            size, factor = size * 2, factor * factor & 0xFFFFFFFF
        parts.append((h, factor))
    (eight, by_eight), (sixteen, _) = parts
    count = n - GRAM + 1
    h = sixteen[:count] * np.uint32(by_eight) + eight[16:16 + count]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    h = (h ^ (h >> np.uint32(15))) | np.uint32(1)
    least = _slide(h, REACH + 1, np.minimum)  # by start of a string
    for end in ends[:-1]:
        least[max(0, end - LENGTH + 1):end] = 0  # strings across two texts
    padded = np.concatenate([np.zeros(REACH, np.uint32), least, np.zeros(REACH, np.uint32)])
    return np.flatnonzero(_slide(padded, REACH + 1, np.maximum)[:count] == h)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes and ends of runs of texts of about SLICE bytes."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE or i == len(texts) - 1:
            run = texts[first:i + 1]
            yield first, np.frombuffer(b"".join(run), np.uint8), np.cumsum([len(t) for t in run])
            first, held = i + 1, 0


def _sampled(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first text, bytes, ends, sampled positions and the 48-bit hashes of their grams."""
    for first, data, ends in _slices(texts):
        at = samples(data, ends)
        if len(at):
            yield first, data, ends, at, _hash_bytes(data[at[:, None] + np.arange(GRAM)]) & MASK48


def _short(x: np.ndarray) -> bytes:
    """Six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _texts(rows: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Distinct texts of a group in a fixed order, with SHA-256 and smallest doc_id."""
    found: dict[bytes, list] = {}
    for sha, doc_id, text in zip(rows["sha"].to_pylist(), rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
        seen = found.setdefault(sha, [doc_id, text])
        seen[0] = min(seen[0], doc_id)
        seen[1] = text if seen[1] is None else seen[1]
    order = sorted(found)
    return order, [found[s][1] for s in order], np.array([found[s][0] for s in order], np.int64)


def dealt_texts(docs: DataFrame, groups: int) -> DataFrame:
    """The distinct texts of each sending task, by group. A later copy with a smaller doc_id follows without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            keep, texts = [], []
            for i, (sha, doc_id) in enumerate(zip(batch["sha"].to_pylist(), batch["doc_id"].to_pylist(), strict=True)):
                before = seen.get(sha)
                if before is None or doc_id < before:
                    keep.append(i)
                    texts.append(None if before is not None else batch["text"][i].as_py())
                    if len(seen) >= SEEN:
                        seen.clear()
                        texts[-1] = batch["text"][i].as_py()
                    seen[sha] = doc_id
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["gid"], part["sha"], part["doc_id"], pa.array(texts, pa.binary())],
                                             ["gid", "sha", "doc_id", "text"])

    text = whole_text(docs).cast("binary")
    rows = docs.select(F.pmod(F.xxhash64(text), F.lit(groups)).alias("gid"), F.unhex(F.sha2(text, 256)).alias("sha"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, TEXTS)


def shared_grams(texts: DataFrame, groups: int) -> DataFrame:
    """Per group the grams that other texts have, too, and whether they occur often."""

    def gather(rows: pa.Table) -> pa.Table:
        gid = rows["gid"][0].as_py()
        found = []
        for first, _, ends, at, grams in _sampled(_texts(rows)[1]):
            owner = first + np.searchsorted(ends, at, side="right")
            order = np.lexsort((owner, grams))
            g, o = grams[order], owner[order]
            found.append(g[np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])])  # once per text
        grams, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64),) * 2
        bucket = grams % U64(groups)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        cuts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        return pa.table({
            "bucket": pa.array(names.astype(np.int64)), "gid": pa.array([gid] * len(cuts), pa.int64()),
            "grams": pa.array([_short(grams[c]) for c in cuts], pa.binary()),
            "counts": pa.array([np.minimum(counts[c], 65535).astype("<u2").tobytes() for c in cuts], pa.binary())})

    def count(rows: pa.Table) -> pa.Table:
        parts = [_long(x) for x in rows["grams"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in rows["counts"].to_pylist()]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=counts)[inverse]
        out, at = [], 0
        for gid, part in zip(rows["gid"].to_pylist(), parts, strict=True):
            own = total[at:at + len(part)]
            at += len(part)
            if (own > 1).any():
                out.append((gid, _short(part[own > 1]), (own[own > 1] >= OFTEN).astype(np.uint8).tobytes()))
        gids, grams, often = zip(*out) if out else ([], [], [])
        return pa.table({"gid": pa.array(gids, pa.int64()), "grams": pa.array(grams, pa.binary()), "often": pa.array(often, pa.binary())})

    return texts.groupBy("gid").applyInArrow(gather, GRAMS).groupBy("bucket").applyInArrow(count, SHARED)


def _surroundings(texts: list[bytes], docs: np.ndarray, answer: pa.Table) -> tuple[np.ndarray, ...]:
    """Of samples with shared grams: text number, position, bytes left and right of it (at most REACH and LENGTH), the bytes
    around, the gram and whether it is frequent; then the number of the entry that stands for all with equal surroundings,
    the one with the smallest doc_id."""
    grams = np.concatenate([np.zeros(0, U64), *(_long(x) for x in answer["grams"].to_pylist() if x)])
    often = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in answer["often"].to_pylist() if x)])
    order = np.argsort(grams)
    grams, often = grams[order], often[order]
    parts = []
    for first, data, ends, at, own in _sampled(texts):
        where = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
        keep = grams[where] == own if len(grams) else np.zeros(len(own), bool)
        at, own, where = at[keep], own[keep], where[keep]
        text = np.searchsorted(ends, at, side="right")
        start = np.concatenate([[0], ends])[text]
        left, right = np.minimum(at - start, REACH), np.minimum(ends[text] - at, LENGTH)
        index = at[:, None] + np.arange(-REACH, LENGTH)
        inside = (np.arange(-REACH, LENGTH) >= -left[:, None]) & (np.arange(-REACH, LENGTH) < right[:, None])
        around = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
        parts.append((first + text, at - start, left, right, around, own, often[where]))
    if not parts:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros((0, AROUND), np.uint8), np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
    text, at, left, right, around, own, frequent = (np.concatenate(x) for x in zip(*parts))
    alike = np.empty(len(at), dtype=f"V{AROUND + 2}")
    alike.view(np.uint8).reshape(-1, AROUND + 2)[:] = np.concatenate(
        [around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
    by_doc = np.lexsort((at, text, docs[text]))
    first_of: dict[bytes, int] = {}
    stands = np.empty(len(at), np.int64)
    for i, raw in zip(by_doc.tolist(), alike[by_doc].tolist()):
        stands[i] = first_of.setdefault(raw, i)
    return text, at, left, right, around, own, frequent, stands


def _string_heads(some: np.ndarray, string: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each entry the entry with the same string and the smallest doc_id; ``by``: the doc_id of each."""
    first_of: dict[bytes, int] = {}
    heads = np.empty(len(some), np.int64)
    for i in np.argsort(by, kind="stable").tolist():
        heads[i] = first_of.setdefault(string[i].tobytes(), some[i])
    return heads


def entries_of(texts: DataFrame, shared: DataFrame, groups: int) -> DataFrame:
    """The samples with the bytes around them, by bucket. ``limits``: bytes left, bytes right, first and last start before the sample."""

    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(rows) or not len(answer):
            return pa.table({c: pa.array([], t) for c, t in zip(("bucket", "gid", "keys", "docs", "places", "limits", "around"),
                                                                (pa.int64(), pa.int64(), *(pa.binary(),) * 5))})
        gid = rows["gid"][0].as_py()
        _, raw, docs = _texts(rows)
        text, at, left, right, around, own, frequent, stands = _surroundings(raw, docs, answer)
        chosen = np.flatnonzero(stands == np.arange(len(stands)))
        plain = chosen[frequent[chosen] == 0]
        picks, keys = [plain], [own[plain]]
        limits = [np.stack([left[plain], right[plain], np.zeros(len(plain)), np.full(len(plain), REACH)], axis=1)]
        hot = chosen[frequent[chosen] == 1]
        for before in range(REACH + 1):
            some = hot[(left[hot] >= before) & (right[hot] >= LENGTH - before)]
            string = around[some][:, REACH - before:REACH - before + LENGTH]
            # of equal strings in this group the one with the smallest doc_id is sent
            head = _string_heads(some, string, docs[text[some]]) == some
            some, string = some[head], string[head]
            picks.append(some)
            keys.append(_hash_bytes(string))
            limits.append(np.stack([left[some], right[some], np.full(len(some), before), np.full(len(some), before)], axis=1))
        pick, key = np.concatenate(picks), np.concatenate(keys)
        limit = np.concatenate(limits).astype(np.uint8)
        bucket = _mix(key) % U64(groups)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        cuts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        place = np.stack([text, at], axis=1).astype("<u4")
        binary = lambda values: pa.array([v.tobytes() for v in values], pa.binary())
        return pa.table({
            "bucket": pa.array(names.astype(np.int64)), "gid": pa.array([gid] * len(cuts), pa.int64()),
            "keys": binary(key[c].astype("<u8") for c in cuts), "docs": binary(docs[text[pick[c]]].astype("<i8") for c in cuts),
            "places": binary(place[pick[c]] for c in cuts), "limits": binary(limit[c] for c in cuts),
            "around": binary(around[pick[c]] for c in cuts)})

    return texts.groupBy("gid").cogroup(shared.groupBy("gid")).applyInArrow(run, ENTRIES)


def marked(key: np.ndarray, docs: np.ndarray, limits: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Bit b of an entry: the string that starts b bytes before its sample also starts in a document with a smaller doc_id.

    Strings are grouped by a hash of string and key, and each is compared with the first of its group byte by byte.
    """
    order = np.argsort(docs, kind="stable")
    key, docs, limits, around = key[order], docs[order], limits[order], around[order]
    out = np.zeros(len(key), np.uint32)
    for before in range(REACH + 1):
        some = np.flatnonzero((limits[:, 0] >= before) & (limits[:, 1] >= LENGTH - before)
                              & (limits[:, 2] <= before) & (limits[:, 3] >= before))
        string = np.ascontiguousarray(around[some, REACH - before:REACH - before + LENGTH])
        name = _hash_bytes(string) ^ _mix(key[some])
        while len(some):
            rank = np.argsort(name, kind="stable")
            head = np.maximum.accumulate(np.where(np.concatenate([[True], name[rank[1:]] != name[rank[:-1]]]), np.arange(len(rank)), 0))
            first = rank[head]
            same = (string[rank] == string[first]).all(axis=1)
            hit = same & (docs[some[first]] < docs[some[rank]])
            out[some[rank[hit]]] |= np.uint32(1 << before)
            rest = rank[~same]  # other strings with an equal hash go on among themselves
            some, string, name = some[rest], string[rest], name[rest]
    back = np.empty_like(out)
    back[order] = out
    return back


def marks_of(entries: DataFrame) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        parts = {c: [x for x in rows[c].to_pylist()] for c in ("keys", "docs", "places", "limits", "around")}
        sizes = [len(x) // 8 for x in parts["keys"]]
        found = marked(
            np.frombuffer(b"".join(parts["keys"]), "<u8"), np.frombuffer(b"".join(parts["docs"]), "<i8"),
            np.frombuffer(b"".join(parts["limits"]), np.uint8).reshape(-1, 4),
            np.frombuffer(b"".join(parts["around"]), np.uint8).reshape(-1, AROUND))
        places = np.frombuffer(b"".join(parts["places"]), "<u4").reshape(-1, 2)
        out, at = [], 0
        for gid, n in zip(rows["gid"].to_pylist(), sizes, strict=True):
            own = at + np.flatnonzero(found[at:at + n])
            at += n
            if len(own):
                out.append((gid, places[own].tobytes(), found[own].astype("<u4").tobytes()))
        gids, where, marks = zip(*out) if out else ([], [], [])
        none = pa.array([None] * len(gids), pa.binary())
        return pa.table({"gid": pa.array(gids, pa.int64()), "grams": none, "often": none,
                         "places": pa.array(where, pa.binary()), "marks": pa.array(marks, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, MARKS)


def cut_texts(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per distinct text: SHA-256, bytes, bytes and runs removed, SHA-256 of the rest."""

    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"sha": pa.array([], pa.binary()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
                             "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        shas, raw, docs = _texts(rows)
        text, at, left, right, around, _, frequent, stands = _surroundings(raw, docs, answer)
        marks = np.zeros(len(text), np.uint32)
        order = np.lexsort((at, text))
        place = (text[order].astype(U64) << U64(32)) | at[order].astype(U64)
        for where, found in zip(answer["places"].to_pylist(), answer["marks"].to_pylist(), strict=True):
            if where:
                own = np.frombuffer(where, "<u4").reshape(-1, 2).astype(U64)
                np.bitwise_or.at(marks, order[np.searchsorted(place, (own[:, 0] << U64(32)) | own[:, 1])], np.frombuffer(found, "<u4"))
        hot = np.flatnonzero((stands == np.arange(len(stands))) & (frequent == 1))
        for before in range(REACH + 1):
            some = hot[(left[hot] >= before) & (right[hot] >= LENGTH - before)]
            heads = _string_heads(some, around[some][:, REACH - before:REACH - before + LENGTH], docs[text[some]])
            marks[some] |= ((docs[text[some]] > docs[text[heads]]) | (marks[heads] >> np.uint32(before) & 1 > 0)).astype(np.uint32) << np.uint32(before)
        marks = marks[stands]
        # entries that another one stands for repeat a smaller doc_id of this group
        copies = docs[text] > docs[text[stands]]
        bits = np.arange(REACH + 1)
        starts = [np.zeros(0, np.int64)]
        owners = [np.zeros(0, np.int64)]
        for b in bits:
            ok = (left >= b) & (right >= LENGTH - b) & (((marks >> np.uint32(b)) & 1).astype(bool) | copies)
            starts.append(at[ok] - b)
            owners.append(text[ok])
        start, owner = np.concatenate(starts), np.concatenate(owners)
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(raw) + 1))
        out = []
        for k, data in enumerate(raw):
            own = start[edges[k]:edges[k + 1]]
            gone = spans = 0
            digest = hashlib.sha256()
            if len(own):
                breaks = np.flatnonzero(own[1:] > own[:-1] + LENGTH) + 1
                lows, highs = own[np.concatenate([[0], breaks])], own[np.concatenate([breaks - 1, [len(own) - 1]])] + LENGTH
                spans, gone, done = len(lows), int((highs - lows).sum()), 0
                for a, b in zip(lows.tolist(), highs.tolist()):
                    digest.update(data[done:a])
                    done = b
                digest.update(data[done:])
            else:
                digest.update(data)
            out.append((len(data), gone, spans, digest.hexdigest()))
        n_bytes, removed, spans, kept = zip(*out)
        return pa.table({"sha": pa.array(shas, pa.binary()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return texts.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(run, CUT)


def repeated_bytes(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a LENGTH-byte string over it also starts in a document with a smaller doc_id; all is judged on the
    input. Null texts are empty. Rows without doc_id come after all others and remove nothing from one another, nor do rows
    with the same doc_id. Copies of a text with larger ids are removed whole. No documents: no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "suffix-rows")
    text = whole_text(docs).cast("binary")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                F.octet_length(text).cast("long").alias("size")).write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    texts = dealt_texts(docs, groups)
    shared = shared_grams(texts, groups)
    marks = marks_of(entries_of(texts, shared, groups))
    none = F.lit(None).cast("binary")
    answers = marks.unionByName(shared.withColumns({"places": none, "marks": none}))
    cut_path = scratch_path(spark, "suffix-cut")
    cut_texts(texts, answers).write.parquet(cut_path)
    cut = spark.read.schema(CUT).parquet(cut_path)
    order = F.coalesce("doc_id", F.lit(LAST))
    first = rows.groupBy("sha").agg(F.min(order).alias("first"))
    found = rows.join(first.join(cut, "sha"), "sha")
    whole = (order > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return found.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
