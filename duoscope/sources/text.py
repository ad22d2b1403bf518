"""Text inputs: item, rating, tag and name files, and ``(a,b)`` pair files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed

ITEM_LINE = r"^([^,]*),(.*),([^,]*)$"
PAIR_LINE = r"^\(([^,]*),([^,)]*)\)$"


def read_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """All lines but those equal to the header, in whichever part they are, and empty ones."""
    lines = spark.read.text(path).where(F.col("value") != "")
    return lines if header is None else lines.where(F.col("value") != header)


def fitting(lines: DataFrame, pattern: str, what: str) -> DataFrame:
    """The lines, if all of them fit the pattern; a bad line ends the job with an error instead of vanishing.

    The check is a filter: it runs whichever columns are read, also for a mere count.
    """
    bad = F.raise_error(F.concat(F.lit(f"not a line of {what}: "), F.substring("value", 1, 200)))
    return lines.where(F.when(F.col("value").rlike(pattern), F.lit(True)).otherwise(bad.cast("boolean")))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``id,title,genres`` split at the first and the last comma; quotes are kept."""
    return parse_items(read_lines(spark, path, fixed.ITEMS_HEADER))


def parse_items(lines: DataFrame) -> DataFrame:
    def part(i: int) -> Column:
        return F.regexp_extract("value", ITEM_LINE, i)

    return fitting(lines, ITEM_LINE, "items").select(
        part(1).cast("bigint").alias("item_id"),
        part(2).alias("title"),
        part(3).alias("genres"),
    )


def _fields(spark: SparkSession, path: str, header: str, what: str) -> tuple[DataFrame, Column]:
    """Lines of as many comma-separated fields as the header has; numbers are cast and fail when they are none."""
    n = header.count(",")
    return fitting(read_lines(spark, path, header), r"^[^,]*(,[^,]*){%d}$" % n, what), F.split("value", ",", -1)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    lines, field = _fields(spark, path, fixed.RATINGS_HEADER, "ratings")
    return lines.select(
        field[0].cast("bigint").alias("user_id"), field[1].cast("bigint").alias("item_id"), field[2].cast("double").alias("rating"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    lines, field = _fields(spark, path, fixed.TAGS_HEADER, "tag scores")
    return lines.select(
        field[0].cast("bigint").alias("item_id"), field[1].cast("int").alias("tag_id"), field[2].cast("double").alias("relevance"))


def read_tag_names(spark: SparkSession, path: str) -> DataFrame:
    """``id,name`` split at the first comma; positions are 0-based."""
    line = r"^([^,]*),(.*)$"
    return fitting(read_lines(spark, path, fixed.TAG_NAMES_HEADER), line, "tag names").select(
        (F.regexp_extract("value", line, 1).cast("int") - 1).alias("pos"),
        F.regexp_extract("value", line, 2).alias("name"),
    )


def read_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Lines ``(a,b)``; the first number may be written as a double."""
    return fitting(read_lines(spark, path), PAIR_LINE, "pairs").select(
        F.regexp_extract("value", PAIR_LINE, 1).cast("double").cast("bigint").alias(first),
        F.regexp_extract("value", PAIR_LINE, 2).cast("bigint").alias(second),
    )


def read_cluster_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "cluster_id", "size")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "item_id", "idx")


def write_pairs(df: DataFrame, first: str, second: str, path: str) -> None:
    df.select(F.format_string("(%s,%s)", F.col(first), F.col(second)).alias("value")).write.text(path)
