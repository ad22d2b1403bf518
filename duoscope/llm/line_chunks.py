"""Duplicate line chunks; DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so boundaries move with the text when
lines are inserted elsewhere. Chunks of two lines or more whose bytes occur more than once in all documents are kept at
their first place (smallest doc_id, then place in the text) and removed elsewhere.

One chunking finds a short passage only where its own lines happen to be a chunk. ``remove_repeated_passages`` takes every
pair of neighbouring lines for a chunk, which covers what any chunking with chunks of two lines or more can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import query, whole_text
from duoscope.session import scratch_path, table

#: On average one of so many lines ends a chunk.
SPACING = 3
FACTOR, MODULUS = 1_000_003, 2_147_483_647


def _identified(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def _chunked(rows: DataFrame, spacing: int) -> DataFrame:
    """rows and ``chunks``: their encoded texts. A line that goes on a chunk is marked ``=``, one that starts one ``>``; lines
    hold no line breaks, so a break and ``>`` is the start of a chunk and nothing else."""
    lines = F.split("text", "\n", -1)
    number = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    rows = rows.withColumn("_lines", lines).withColumn("_h", number)
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("_h"))
    ends = F.zip_with(before, "_h", lambda a, b: ((a * FACTOR + b) % MODULUS) % spacing == 0)
    # the mark of a line says whether the line before it ended a chunk; zip_with pads the shorter list with nulls
    rows = rows.withColumn("_marks", F.concat(F.array(F.lit(True)), ends))
    marked = F.zip_with("_lines", "_marks", lambda x, m: F.when(x.isNotNull(), F.concat(F.when(m, ">").otherwise("="), x)))
    joined = F.array_join(marked, "\n")  # leaves the padding out
    return rows.withColumn("chunks", F.split(F.substr(joined, F.lit(2)), "\n>", -1)).drop("_lines", "_h", "_marks")


def _lines_of(chunk: Column) -> Column:
    return (F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit("")))).cast("long") + 1


def remove_repeated_chunks(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """Per row of ``docs``: doc_id, text without the removed chunks, n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    Null counts as empty, an empty text is one empty line. Repeats within a document count as repeats; rows without doc_id
    come after all others; rows that repeat both doc_id and text are one document and get the same result. The lines left
    are joined by line breaks as before. No documents: no rows. Keys are counted first; only chunks whose key repeats are
    moved with their text, and they are compared by that text.
    """
    spark = docs.sparkSession
    rows = _identified(docs)
    every = _chunked(rows, spacing).select("rid", "doc_id", F.posexplode("chunks").alias("place", "chunk"))
    every = every.where(F.contains("chunk", F.lit("\n"))).withColumn("key", F.xxhash64("chunk"))
    repeated = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    candidates_path = scratch_path(spark, "line-chunks")
    every.join(repeated.hint("merge"), "key", "left_semi").write.parquet(candidates_path)
    candidates = spark.read.parquet(candidates_path)
    # both joins with texts are merges at every size: keys and marks grow with the data
    # equal bytes meet under one key; a hash decides nothing
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "place")
    first = candidates.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    gone = candidates.join(first, ["key", "chunk"]).where(place != F.col("first"))
    gone = gone.groupBy("rid").agg(F.collect_set("place").alias("gone"))
    out = _chunked(rows.join(gone.hint("merge"), "rid", "left"), spacing)
    numbered = F.transform("chunks", lambda c, i: F.struct(c.alias("c"), F.coalesce(F.array_contains("gone", i), F.lit(False)).alias("gone")))
    out = out.withColumn("_numbered", numbered)
    left = F.transform(F.filter("_numbered", lambda x: ~x["gone"]), lambda x: x["c"])
    lost = F.transform(F.filter("_numbered", lambda x: x["gone"]), lambda x: x["c"])
    text = F.replace(F.array_join(left, "\n"), F.lit("\n="), F.lit("\n"))
    return out.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"),
        _lines_of(F.col("text")).alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
        F.size(lost).cast("long").alias("n_removed_chunks"),
        F.aggregate(lost, F.lit(0).cast("long"), lambda n, c: n + _lines_of(c)).alias("n_removed_lines"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, CAST('0x' || substr(md5(lines[i]), 1, 8) AS BIGINT) AS h
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
e AS (SELECT *, (coalesce(lag(h) OVER w, 0) * {FACTOR} + h) % {MODULUS} % {SPACING} = 0 AS ends
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM k GROUP BY doc_id, chunk),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY text, n ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
       CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_lines,
       sha256(coalesce(string_agg(text, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@query("op3_line_chunks", OP3_SQL)
def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines",
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _pairs(rows: DataFrame) -> DataFrame:
    """rid, doc_id, place and pair: every line with the one after it."""
    lines = F.split("text", "\n", -1)
    both = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.concat(a, F.lit("\n"), b))
    # the last line has none after it; zip_with pads with null
    return rows.select("rid", "doc_id", F.posexplode(both).alias("place", "pair")).where("pair is not null")


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text without the repeated passages, n_lines, n_removed_passages, n_removed_lines.

    A line goes when it and a neighbour are a pair whose bytes have an earlier place (smallest doc_id, then place in the
    text), so every repeated run of two lines or more goes whatever surrounds it; a removed passage is a run of lines gone.
    Every line stays at the first of its places that pairs lead to. Nulls, empty texts, rows without doc_id and repeated
    rows are as in ``remove_repeated_chunks``. Only pairs whose key repeats are moved with their text and compared by it.
    """
    spark = docs.sparkSession
    rows = _identified(docs)
    every = _pairs(rows).withColumn("key", F.xxhash64("pair"))
    repeated = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    candidates_path = scratch_path(spark, "line-passages")
    every.join(repeated.hint("merge"), "key", "left_semi").write.parquet(candidates_path)
    candidates = spark.read.parquet(candidates_path)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "place")
    first = candidates.groupBy("key", "pair").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    again = candidates.join(first, ["key", "pair"]).where(place != F.col("first"))
    again = again.groupBy("rid").agg(F.collect_set("place").alias("again"))
    out = rows.join(again.hint("merge"), "rid", "left").withColumn("_lines", F.split("text", "\n", -1))
    gone = F.coalesce(F.array_union("again", F.transform("again", lambda i: i + 1)), F.array().cast("array<int>"))
    out = out.withColumn("_gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    starts = F.array_except("_gone", F.transform("_gone", lambda i: i + 1))
    return out.select(
        "doc_id", F.when(F.col("again").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"), F.size(starts).cast("long").alias("n_removed_passages"),
        F.size("_gone").cast("long").alias("n_removed_lines"))


PASSAGES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
p AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM l),
a AS (SELECT *, pair IS NOT NULL AND row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) > 1 AS again FROM p),
g AS (SELECT *, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS gone FROM a),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM g)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (starts) AS n_removed_passages, count(*) FILTER (gone) AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@query("op3_line_passages", PASSAGES_SQL)
def op3_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed_passages", "n_removed_lines",
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
