"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame functions only.

Every document gets a hash of its id. A source whose target is T and whose size is S takes all documents floor(T/S) times
and, once more, those whose hash is below a threshold chosen so that their sizes add up to the rest. The threshold is found
by histograms: sizes by source and the leading hash bits, then only the bucket the rest falls into by the next bits, and so
on. Nothing is sorted, and no row is dropped to find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.llm.registry import packed, query, whole_text
from duoscope.session import cut_lineage, scratch_path, table

WEIGHTS = (1, 2, 3)
CAP = 3
#: Bits of each histogram level, from the leading ones down.
LEVELS = (10, 10, 10, 10)
#: A table of sources is sent to all executors up to this many rows; beyond, joins shuffle and give the same rows.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """A 40-bit hash of the doc_id. Rows without doc_id are told apart by their text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 10), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        words(whole_text(docs)).alias("size"), hash_of(docs["doc_id"], docs["text"]).alias("h"))


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Per source: s (a never-null key), source_size and target. One row per source throughout.

    Sources in code point order, null last, weigh ``weights`` in turn. The budget is ``share`` of all sizes. Targets stop at
    ``cap`` times the size of their source; what is over goes to the others by weight until none is above. With sources
    sorted by cap/weight the saturated ones are a prefix, so running sums find the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (w % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight)
    # the first source that is not saturated sets the level of all from there on
    free = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("rank", "level")))
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("free", free.over(every))
    target = F.when(F.col("free").isNull() | (F.col("rank") < F.col("free.rank")), F.col("most")).otherwise(
        F.col("free.level") * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(hashed: DataFrame, per_source: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """per_source with ``whole`` (full copies) and ``below`` (documents with a smaller hash are taken once more).

    Each level reads the hash table once, keeps the bucket of each source that the rest falls into and adds up the sizes of
    its sub-buckets: at most 2^bits rows per source. At the last level the cut goes to the nearer side of the bucket.
    """
    whole = F.floor(F.try_divide("target", "source_size"))
    out = per_source.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    out = cut_lineage(out.withColumn("open", F.col("rest") > 0))
    n_sources = out.count()
    shift = sum(levels)
    for depth, bits in enumerate(levels):
        shift -= bits
        side = out.where("open").select(F.col("source").alias("o_source"), "prefix", "rest")
        bucket = F.shiftright("h", shift)
        inside = hashed.join(_small(side, n_sources), hashed["source"].eqNullSafe(side["o_source"]) & (
            F.shiftright("h", shift + bits) == F.col("prefix")))
        hist = inside.groupBy("o_source", "prefix", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("o_source").orderBy("bucket"))
        hist = hist.withColumn("upto", run).where(F.col("upto") > F.col("rest"))
        cut = hist.groupBy("o_source").agg(F.min(F.struct("bucket", "upto", "n")).alias("c")).select(
            F.col("o_source").alias("c_source"), F.lit(True).alias("hit"), F.col("c.bucket").alias("c_bucket"),
            (F.col("c.upto") - F.col("c.n")).alias("c_before"), F.col("c.n").alias("c_n"))
        out = out.join(_small(cut, n_sources), out["source"].eqNullSafe(cut["c_source"]), "left")
        missed = F.col("open") & F.col("hit").isNull()  # all that is left fits
        last = depth == len(levels) - 1
        near = F.col("c_bucket") + F.when(F.lit(last) & (F.col("rest") - F.col("c_before") >= F.col("c_n") / 2), 1).otherwise(0)
        out = cut_lineage(out.select(
            "source", "source_size", "target", "whole",
            F.when(F.col("hit"), F.col("rest") - F.col("c_before")).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("hit"), near).when(missed, F.shiftleft(F.col("prefix") + 1, bits)).otherwise(
                F.shiftleft("prefix", bits)).alias("prefix"),
            (F.col("open") & F.col("hit").isNotNull()).alias("open")))
    return out.select("source", "source_size", "target", "whole", F.col("prefix").alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target and ``copies``, the number of times the mix takes it.

    Sizes are counted once and stored (three numbers and the source per row). Null texts have size 0, null sources are one
    source of their own, repeated rows with one doc_id are taken alike, no documents give no rows. The
    table of sources is counted before it is broadcast.
    """
    hashed, plan = _planned(docs, weights, cap, share)
    return hashed.join(plan, hashed["source"].eqNullSafe(plan["p_source"])).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).alias("copies"))


def _planned(docs: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(docs.sparkSession, "mix-sizes")
    sized(docs).write.parquet(path)
    hashed = docs.sparkSession.read.parquet(path)
    plan = thresholds(hashed, targets(hashed, weights, cap, share)).withColumnRenamed("source", "p_source")
    return hashed, _small(plan, plan.count())


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """row (all columns but text), text and ``copies``, how often the mix takes the row."""
    _, plan = _planned(docs, weights, cap, share)
    rows = packed(docs)
    rows = rows.withColumn("h", hash_of(rows["row"]["doc_id"], rows["text"]))
    out = rows.join(plan, rows["row"]["source"].cast("string").eqNullSafe(plan["p_source"]))
    return out.select("row", "text", (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).alias("copies"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10) AS BIGINT) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
             3.0 * source_size AS most FROM p),
-- one round after another: sources at their cap leave with it, the others share what is left by weight
r AS (
  SELECT 0 AS round, source, source_size, weight, most, CAST(NULL AS DOUBLE) AS fixed,
         (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) AS rest, (SELECT sum(weight) FROM w) AS weights FROM w
  UNION ALL
  SELECT round + 1, source, source_size, weight, most, f,
         first_value(total) OVER () - coalesce(sum(f) OVER (), 0), sum(CASE WHEN f IS NULL THEN weight END) OVER ()
  FROM (SELECT *, coalesce(fixed, CASE WHEN rest / weights * weight >= most THEN most END) AS f,
               sum(source_size) OVER () AS total FROM r)
  WHERE round < 200),
t AS (SELECT source, source_size, coalesce(fixed, rest / weights * weight) AS target FROM r WHERE round = 200),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
b AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
cut AS (
  SELECT q.source, q.target - whole * source_size AS rest, min(c.h) AS h, min_by(c.upto, c.h) AS upto, min_by(c.n, c.h) AS n
  FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source AND c.upto > q.target - whole * source_size
  GROUP BY 1, 2)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(d.size * (whole + CASE WHEN q.target - whole * source_size > 0 AND (cut.h IS NULL OR d.h < cut.h
         OR d.h = cut.h AND cut.rest - (cut.upto - cut.n) >= cut.n / 2) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


@query("op8_mixing", OP8_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
