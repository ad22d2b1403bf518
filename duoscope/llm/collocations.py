"""Phrases whose words belong together, from weighted acyclic automata.

1. Survey: one pass counts the words of every language and takes every so many words a sample of the sequence starting there.
   Samples only choose the prefix ranges; no count depends on them.
2. Count: a task cuts its texts into words, numbers them in byte order and builds an automaton of all sequences of up to four
   words with their counts; blocks of text bound its size. The automaton is cut at the borders of the prefix ranges.
3. Union: the parts of a range meet in one task, which adds the weights of equal sequences. Counts are exact then, and sequences
   below the least count go. The ranges' automata are a written table.
4. Compose: the parts of all candidates are dealt to the ranges that hold them; there the acceptor of the distinct parts is
   composed with the counts.

Sequences never cross a piece. Blocks are cut between pieces; a piece longer than a block is cut between words and the last words
are repeated, but not counted, at the start of the next block. A single word is held whole.

Defined cases: null and empty texts have no words, a null language is ``und``; repeated rows count again; equal scores go by
count and then by the phrase's bytes; an empty table gives no phrases; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duoscope.llm import transducers as tr
from duoscope.llm.registry import query
from duoscope.session import scratch_path, table

LONGEST = 4
LEAST = 30
TOP = 2000
#: Bytes of text from which one automaton is built.
BLOCK_BYTES = 6 << 20
#: Words of the corpus per prefix range. A task holds the automata of a range, some 250 bytes a word.
RANGE_WORDS = 750_000
#: Samples per range; the driver gets them all.
SAMPLES = 16
#: Parts into which equal keys of joins and ranks are dealt.
SALTS = 16
#: A-Z in small letters, what ends a piece as a full stop, tabs as spaces.
SPACE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10 + b" ")


Part = tuple[str, bytes, int]  # language, text, how many words at its start are repeated


# -- words -------------------------------------------------------------------------------------
def parts_of(text: bytes, size: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``size`` bytes, and how many words of the part before each repeats."""
    at, old, room = 0, 0, size
    while len(text) - at > room:
        stop = text.rfind(b".", at, at + room)
        if stop >= 0:
            yield text[at:stop], old
            at, old, room = stop + 1, 0, size
            continue
        stop = text.rfind(b" ", at, at + room)
        words = text[at:stop].rsplit(None, old + overlap) if stop >= 0 else []
        if len(words) <= old + overlap:  # no new word to start the next part after
            room *= 2
            continue
        yield text[at:stop], old
        at, old, room = at + len(text[at:stop].rsplit(None, overlap)[0]), overlap, size
    yield text[at:], old


def blocks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[Part]:
    """The texts of a language joined to blocks of about ``size`` bytes; pieces are separated by ``.``."""
    held: dict[str, list[bytes]] = {}
    length = 0

    def joined() -> Iterator[Part]:
        for lang, texts in held.items():
            yield lang, b".".join(texts), 0
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_buffer().to_pybytes().translate(SPACE)
            if len(text) > size:
                for part, old in parts_of(text, size, overlap):
                    yield lang, part, old
                continue
            if length + len(text) > size:
                yield from joined()
                length = 0
            held.setdefault(lang, []).append(text)
            length += len(text)
    yield from joined()


def numbered(block: bytes, old: int) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Sorted words, the block as their numbers with -1 for breaks, and which words are counted here."""
    text = pa.array([block.replace(b".", b" . ").strip()], pa.large_binary()).view(pa.large_string())
    if not len(text[0].as_buffer()):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    tokens = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    words, place = tr.in_order(tokens.dictionary.view(pa.large_binary()))
    ids = place[tokens.indices.to_numpy()]
    dot, there = tr.word_place(words, b".")
    if there:
        ids = np.where(ids == dot, -1, ids - (ids > dot))
        words = pa.concat_arrays([words[:dot], words[dot + 1:]])
    new = np.ones(len(ids), bool)
    new[:old] = False
    return words, ids, new


def read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


# -- counting ----------------------------------------------------------------------------------
def survey(docs: DataFrame, range_words: int = RANGE_WORDS, longest: int = LONGEST, size: int = BLOCK_BYTES) -> DataFrame:
    """Words of each language by task, and the sequences that start at every so many words."""
    step = max(1, range_words // SAMPLES)
    schema = "lang string, n long, samples array<array<binary>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() * 7919 % step  # tasks do not all start with the same place
        found: dict[str, list] = {}
        for lang, block, old in blocks(batches, size, longest - 1):
            words, ids, new = numbered(block, old)
            at = np.flatnonzero((ids >= 0) & new)
            mine = found.setdefault(lang, [0, []])
            mine[0] += len(at)
            for i in at[(-seen) % step::step]:
                run = ids[i:i + longest]
                stop = np.flatnonzero(run < 0)
                mine[1].append([words[int(w)].as_py() for w in run[:stop[0] if len(stop) else longest]])
            seen = (seen + len(at)) % step
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()),
             pa.array([s for _, s in found.values()], pa.list_(pa.list_(pa.binary())))], ["lang", "n", "samples"])

    return read(docs).mapInArrow(look, schema)


def borders(surveyed: DataFrame) -> list[tuple[bytes, ...]]:
    """First sequences, language first, of all prefix ranges but the first; a few bytes per range."""
    rows = surveyed.where("size(samples) > 0").select("lang", F.explode("samples").alias("s")).collect()
    ordered = sorted((r.lang.encode(), *map(bytes, r.s)) for r in rows)
    return sorted(set(ordered[SAMPLES - 1::SAMPLES]))


def counted(docs: DataFrame, bounds: list[tuple[bytes, ...]], least: int = LEAST, longest: int = LONGEST,
            size: int = BLOCK_BYTES) -> DataFrame:
    """One automaton per prefix range (``slot``) and language, of all sequences that occur ``least`` times or more."""
    schema = "slot int, lang string, automaton binary"
    names = [b[0] for b in bounds]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, old in blocks(batches, size, longest - 1):
            words, ids, new = numbered(block, old)
            if not len(words):
                continue
            first, last = bisect_left(names, lang.encode()), bisect_right(names, lang.encode())
            parts = tr.cut(tr.built(words, ids, new, longest), [b[1:] for b in bounds[first:last]])
            rows = [(first + i, tr.stored(t)) for i, t in enumerate(parts) if t is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([lang] * len(rows)), pa.array([a for _, a in rows], pa.binary())],
                ["slot", "lang", "automaton"])

    def add(group: pa.Table) -> pa.Table:
        by_lang: dict[str, list[tr.Tree]] = {}
        for lang, automaton in zip(group["lang"].to_pylist(), group["automaton"]):
            by_lang.setdefault(lang, []).append(tr.loaded(automaton.as_py()))
        out = []
        for lang in sorted(by_lang):
            total = tr.pruned(tr.union(by_lang.pop(lang)), least)
            if len(total.words):
                out.append((group["slot"][0].as_py(), lang, tr.stored(total)))
        return pa.Table.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()),
             pa.array([r[2] for r in out], pa.binary())], ["slot", "lang", "automaton"])

    return read(docs).mapInArrow(shards, schema).groupBy("slot").applyInArrow(add, schema)


def phrases(automata: DataFrame) -> DataFrame:
    """All sequences of the automata with their counts."""
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, automaton in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                for k, (phrase, weight) in enumerate(tr.sequences_of(tr.loaded(automaton.as_py()))):
                    own = np.flatnonzero(weight > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array([k + 1] * len(own), pa.int32()),
                         pa.array(phrase[own], pa.binary()).cast(pa.string()), pa.array(weight[own])],
                        ["lang", "size", "phrase", "f"])

    return automata.select("lang", "automaton").mapInArrow(unfold, "lang string, size int, phrase string, f long")


def looked_up(automata: DataFrame, parts: DataFrame, bounds: list[tuple[bytes, ...]]) -> DataFrame:
    """``f`` of every distinct (lang, part), composed with the automaton of its range."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [bisect_right(bounds, (lang.encode(), *part.encode().split(b" ")))
                     for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), batch.column("lang"), batch.column("part")],
                                             ["slot", "lang", "part"])

    def compose(counts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for lang, automaton in zip(counts["lang"].to_pylist(), counts["automaton"]):
            mine = asked.filter(pc.equal(asked["lang"], lang))
            if mine.num_rows:
                found = tr.composed([tuple(p.split(b" ")) for p in mine["part"].cast(pa.binary()).to_pylist()],
                                    tr.loaded(automaton.as_py()))
                out.append(pa.Table.from_arrays([mine["lang"], mine["part"], pa.array(found)], ["lang", "part", "f"]))
        empty = pa.schema([("lang", pa.string()), ("part", pa.string()), ("f", pa.int64())]).empty_table()
        return pa.concat_tables(out) if out else empty

    dealt = parts.select("lang", "part").distinct().mapInArrow(route, "slot int, lang string, part string")
    return automata.groupBy("slot").cogroup(dealt.groupBy("slot")).applyInArrow(compose, "lang string, part string, f long")


# -- phrases -----------------------------------------------------------------------------------
def _joined(first: Column | int, count: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", first, count))


def scored(found: DataFrame, automata: DataFrame, bounds: list[tuple[bytes, ...]]) -> DataFrame:
    """Phrases of two words and more with the parts and score of their weakest cut."""
    split = found.where("size > 1").withColumn("words", F.split("phrase", " ", -1))
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _joined(1, F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("p"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", "p.side", "p.part",
                       F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    sums = looked_up(automata, cuts, bounds).select(
        "lang", "part", "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = cuts.join(sums, ["lang", "part", "salt"]).groupBy("lang", "phrase", "size", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return weakest.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def outermost(candidates: DataFrame) -> DataFrame:
    """Without phrases that at least four fifths of the time are part of one longer phrase."""
    words = candidates.where("size > 2").withColumn("words", F.split("phrase", " ", -1))
    inner = words.select("lang", "words", "size", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    most = inner.select("lang", _joined(F.col("at"), F.col("m")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(
        F.max("longer").alias("longer"))
    wide = "decimal(19,0)"
    covered = (F.col("longer").cast(wide) * 5 >= F.col("a").cast(wide) * 4)
    return candidates.join(most, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; every language is ranked in parts before its best meet."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, range_words: int = RANGE_WORDS,
                 longest: int = LONGEST, size: int = BLOCK_BYTES) -> DataFrame:
    """The strongest phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    first, second, third = (scratch_path(spark, f"phrases-{x}") for x in ("survey", "counts", "scored"))
    survey(docs, range_words, longest, size).write.parquet(first)
    surveyed = spark.read.parquet(first)
    bounds = borders(surveyed)
    counted(docs, bounds, least, longest, size).write.parquet(second)
    automata = spark.read.parquet(second)
    scored(phrases(automata), automata, bounds).write.parquet(third)
    totals = surveyed.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked(outermost(spark.read.parquet(third)), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, CAST(len(words) AS BIGINT) - k + 2),
         lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30),
cuts AS MATERIALIZED (
  SELECT lang, phrase, size, a, v.k, array_to_string(words[1:v.k], ' ') AS p, array_to_string(words[v.k + 1:], ' ') AS q
  FROM c, (VALUES (1), (2), (3)) AS v(k) WHERE v.k < c.size),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.size, cuts.a, cuts.k, l.f AS l, r.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = p JOIN f AS r ON r.lang = cuts.lang AND r.phrase = q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT c.lang, array_to_string(c.words[i.i:i.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c, (VALUES (2), (3)) AS m(m), (VALUES (1), (2), (3)) AS i(i)
  WHERE m.m < c.size AND i.i + m.m - 1 <= c.size GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
       b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE NOT coalesce(100 * CAST(x.longer AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT), false)
QUALIFY rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
