"""Columnar and libsvm inputs and outputs of the jobs."""

from __future__ import annotations

import uuid
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoscope.functions import vectors as V
from duoscope.session import collect_bounded, cut_lineage, scratch_path

SIDES = ("left", "right")
BLOCKS = ("bin", "tri", "num")
MAX_SPLITS = 1_000_000
MAX_SEEDS = 8
WIDTHS = [f"{side}_{block}" for side in SIDES for block in BLOCKS]
#: What vectors are in storage: type 0 has indices and values, type 1 values only.
STORED_ROWS = "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
VECTOR_ROWS = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])


# -- libsvm ---------------------------------------------------------------------------------

def write_libsvm(df: DataFrame, features: str, path: str, label: str | None = None) -> None:
    """An array column as libsvm lines, one file per partition."""
    lab = F.col(label).cast("double") if label else F.lit(0.0)
    df.select(lab.alias("label"), array_to_vector(features).alias("features")).write.format(
        "libsvm"
    ).save(path)


def write_sparse_libsvm(rows: DataFrame, path: str) -> None:
    """``(pos, val)``, ascending, as libsvm lines with label 0; zeros need not be stored."""
    rows.select(F.concat_ws(" ", F.lit("0.0"), libsvm_cells(F.col("pos"), F.col("val"))).alias("value")).write.text(path)


def libsvm_cells(pos: Column, val: Column) -> Column:
    """``pos:val`` of every position, counted from 1, with blanks between them."""
    listed = F.arrays_zip(pos.alias("pos"), val.alias("val"))
    return F.array_join(F.transform(listed, lambda c: F.concat_ws(":", (c["pos"] + 1).cast("string"), c["val"].cast("string"))), " ")


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``label double, features array<double>``; the width keeps trailing zeros."""
    return read_libsvm_vectors(spark, path, width).select("label", vector_to_array("features").alias("features"))


def read_libsvm_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``label double, features vector``, sparse as stored."""
    return spark.read.format("libsvm").option("numFeatures", width).load(path)


def libsvm_to_parquet(spark: SparkSession, path: str, width: int, out: str) -> None:
    read_libsvm(spark, path, width).write.parquet(out)


def labeled_point(label, dense):
    """``(label double, features vector)`` columns for pyspark.ml."""
    return label.cast("double").alias("label"), array_to_vector(dense).alias("features")


def split_at(features, n: int):
    """Vector to ``(attributes, 0/1 utilities)`` at position ``n``."""
    rest = F.slice(features, F.lit(n + 1), F.greatest(F.size(features) - n, F.lit(0)))
    return F.slice(features, 1, n), F.transform(rest, lambda v: F.when(v > 0, 1).otherwise(0))


# -- dyads ----------------------------------------------------------------------------------

def write_dyads(dyads: DataFrame, path: str) -> None:
    """Dyads as ``(label double, features vector)`` Parquet and a one-row table of named block widths.

    Input columns: ``left_bin … right_num`` and ``label boolean``; every row has the same widths.
    """
    dense = F.concat(*[V.to_dense(*[F.col(f"{s}_{b}") for b in BLOCKS]) for s in SIDES])
    widths = Observation()  # taken as the rows are written: they are not made a second time for it
    observed = dyads.observe(widths, *V.width_aggregates(*WIDTHS))
    observed.select(*labeled_point(F.col("label"), dense)).write.parquet(f"{path}/rows")
    names = [f"{w}{end}" for w in WIDTHS for end in ("", "_min")]
    row = [tuple(widths.get.get(name) for name in names)]
    dyads.sparkSession.createDataFrame(row, ", ".join(f"{name} int" for name in names)).write.parquet(f"{path}/widths")


def write_sparse_dyads(rows: DataFrame, widths: dict[str, int], path: str) -> None:
    """Sparse dyads ``(label, indices, values)`` with known widths, in the layout of ``write_dyads``.

    The struct has the storage form of a sparse ML vector, so both kinds read back the same way.
    """
    vector = sparse_vector(F.col("indices"), F.col("values"), F.lit(sum(widths.values())))
    rows.select(F.col("label").cast("double").alias("label"), vector.alias("features")).write.parquet(f"{path}/rows")
    values = [(widths.get(w, 0), widths.get(w, 0)) for w in WIDTHS]
    names = ", ".join(f"{w} int, {w}_min int" for w in WIDTHS)
    rows.sparkSession.createDataFrame([tuple(v for pair in values for v in pair)], names).write.parquet(f"{path}/widths")


def sparse_vector(pos: Column, val: Column, size: Column) -> Column:
    """The storage form of a sparse ML vector; Parquet that is read with VECTOR_ROWS gives vectors."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"), pos.alias("indices"), val.alias("values"))


def sparse_vectors(entities: DataFrame, width: int) -> DataFrame:
    """``(…, pos, val)`` with sparse ML vectors ``features``, by way of a written table: no Python, no dense value."""
    path = scratch_path(entities.sparkSession, "vectors")
    entities.withColumn("features", sparse_vector(F.col("pos"), F.col("val"), F.lit(width))).write.parquet(path)
    schema = T.StructType([*entities.schema.fields, T.StructField("features", VectorUDT())])
    return entities.sparkSession.read.schema(schema).parquet(path)


def read_widths(spark: SparkSession, path: str) -> dict[str, int]:
    row = spark.read.parquet(f"{path}/widths").first().asDict()
    for name in WIDTHS:
        if row[name] != row[f"{name}_min"]:
            raise ValueError(f"block {name} has rows of different widths")
    return {name: row[name] for name in WIDTHS}


def read_dyads(spark: SparkSession, path: str, widths: dict[str, int] | None = None) -> DataFrame:
    """Back to blocks; a row of another total width fails the read.

    With ``widths`` given, ``path`` is a plain ``(label, features vector)`` Parquet folder.
    """
    w = read_widths(spark, path) if widths is None else {name: widths.get(name, 0) for name in WIDTHS}
    rows = spark.read.schema(VECTOR_ROWS).parquet(f"{path}/rows" if widths is None else path)
    rows = rows.select("label", vector_to_array("features").alias("f"))
    total, n_left = sum(w.values()), w["left_bin"] + w["left_tri"] + w["left_num"]
    wrong = F.raise_error(F.lit(f"dyad width differs from {total}")).cast("array<double>")
    rows = rows.select("label", F.when(F.size("f") == total, F.col("f")).otherwise(wrong).alias("f"))
    cols = []
    for side, dense in (
        ("left", F.slice("f", 1, n_left)),
        ("right", F.slice("f", n_left + 1, total - n_left)),
    ):
        parts = V.from_dense(dense, w[f"{side}_bin"], w[f"{side}_tri"])
        cols += [p.alias(f"{side}_{b}") for p, b in zip(parts, BLOCKS)]
    return rows.select(*cols, (F.col("label") > 0).alias("label"))


def read_dyad_sides(spark: SparkSession, path: str, widths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int]]:
    """Stored dyads as ids and two vector tables: ``(user_id, item_id, label)``, users and items ``(id, pos, val)``, widths.

    Stored rows have no ids, and every dyad of an entity repeats its vector. The id here is made of the vector itself: a 64-bit hash
    of positions and values, as all later shuffles of dyads carry two of them. Each distinct vector is kept once; where two vectors
    have one id, another seed is taken, so the hashes decide nothing. Equal vectors of different entities become one entity, which
    scores and gradients cannot tell apart.
    """
    w = read_widths(spark, path) if widths is None else {name: widths.get(name, 0) for name in WIDTHS}
    total, n_left = sum(w.values()), w["left_bin"] + w["left_tri"] + w["left_num"]
    rows = spark.read.schema(STORED_ROWS).parquet(f"{path}/rows" if widths is None else path)
    sparse = F.col("features.type") == 0
    size = F.when(sparse, F.col("features.size")).otherwise(F.size("features.values"))
    wrong = F.raise_error(F.lit(f"dyad width differs from {total}"))
    listed = F.arrays_zip(F.col("features.indices").alias("pos"), F.col("features.values").alias("value"))
    entries = F.when(sparse, F.filter(listed, lambda e: e["value"] != 0)).otherwise(V.nonzero(F.col("features.values")))
    rows = rows.where(F.when(size == total, F.lit(True)).otherwise(wrong.cast("boolean"))).select("label", entries.alias("e"))

    def side(first: int, end: int) -> Column:
        own = F.filter("e", lambda e: (e["pos"] >= first) & (e["pos"] < end))
        return F.transform(own, lambda e: F.struct((e["pos"] - first).alias("pos"), e["value"].alias("value")))

    rows = rows.select("label", side(0, n_left).alias("x"), side(n_left, total).alias("y"))

    keys, tables = [], []
    for name, c in (("user_id", "x"), ("item_id", "y")):
        distinct, key = _dictionary(rows, name, c)
        tables.append(distinct)
        keys.append(key.alias(name))
    ids = cut_lineage(rows.select(*keys, (F.col("label") > 0).alias("label")))
    return ids, tables[0], tables[1], (n_left, total - n_left)


def vector_id(seed: int, vector: Column) -> Column:
    return F.xxhash64(F.lit(seed), vector)


def _dictionary(rows: DataFrame, name: str, c: str) -> tuple[DataFrame, Column]:
    """The distinct vectors of a column as ``(name, pos, val)`` and their id, under the first seed that tells all of them apart."""
    for seed in range(1, MAX_SEEDS + 1):
        key = vector_id(seed, F.col(c))
        distinct = cut_lineage(rows.select(key.alias(name), F.col(f"{c}.pos").alias("pos"), F.col(f"{c}.value").alias("val")).distinct())
        if distinct.groupBy(name).count().where("count > 1").isEmpty():
            return distinct, key
    raise ValueError(f"two vectors have the same {name} under {MAX_SEEDS} seeds")


def copy_dyads_orc(spark: SparkSession, path: str, out: str) -> None:
    """A second copy of the decoded dyads in a row-object-friendly format."""
    read_dyads(spark, path).write.orc(out)


# -- maps, codes, factors --------------------------------------------------------------------

def save_once(df: DataFrame, path: str) -> DataFrame:
    """Write unless the table is there, then read what is stored.

    The rows go to a folder of their own beside ``path``, which gets its name only when the write is complete; what a broken-off
    job left has another name and is no table. Of two writers at once the first to finish stays. Nothing is ever overwritten.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        part = jvm.Path(f"{path}-{uuid.uuid4().hex[:12]}")
        df.write.parquet(part.toString())
        plain = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)  # a rename that fails where the target exists
        try:
            jvm.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(part, target, plain)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
    return spark.read.parquet(path)


def write_codes(entities: DataFrame, width: int, path: str) -> None:
    """``(id, pos, val)`` of one side as ``(id, features)`` with sparse vectors."""
    entities.select("id", sparse_vector(F.col("pos"), F.col("val"), F.lit(width)).alias("features")).write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``(id, pos, val, width)`` back from stored vectors."""
    rows = spark.read.schema("id bigint, " + STORED_ROWS.partition(", ")[2]).parquet(path)
    return rows.select("id", F.col("features.indices").alias("pos"), F.col("features.values").alias("val"), F.col("features.size").alias("width"))


def write_factors(factors: DataFrame, path: str, biased_left: bool, biased_right: bool) -> None:
    """Long ``(side, row, col, value)`` table with the bias flags as columns."""
    biased = F.when(F.col("side") == "W", F.lit(biased_left)).otherwise(F.lit(biased_right))
    factors.select("side", "row", "col", "value", biased.alias("biased")).write.parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_factor_csv(factors: DataFrame, prefix: str, biased_left: bool, biased_right: bool, parts: int | None = None) -> str:
    """The pair ``<prefix>_<left>_<right>_W.csv`` and ``…_V.csv``, one line per matrix row.

    Lines are dealt to files by ranges of rows, so the files in the order of their names hold the matrix from top to bottom.
    """
    full = f"{prefix}_{str(biased_left).lower()}_{str(biased_right).lower()}"
    for name in ("W", "V"):
        cells = factors.where(F.col("side") == name)
        lines = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("cells")).select(
            "row", F.array_join(F.col("cells.value").cast("array<string>"), ",").alias("value"))
        ranges = lines.repartitionByRange(parts, "row") if parts else lines.repartitionByRange("row")
        ranges.sortWithinPartitions("row").select("value").write.text(f"{full}_{name}.csv")
    return full


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of all files below ``path`` with their number from 0: files by name, then the order inside a file.

    Splits of files are read in parallel; a line's number is its place in the split plus the lines of the splits before it.
    """
    split = ("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col(split[0]).alias("file"), F.col(split[1]).alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = cut_lineage(lines.where(F.trim("value") != ""))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["file"], r["block"], r["n"]) for r in collect_bounded(counts, MAX_SPLITS, "splits of text files"))
    starts = accumulate((n for *_, n in found), initial=0)
    before = spark.createDataFrame([(f, b, s) for (f, b, _), s in zip(found, starts)], "file string, block bigint, before bigint")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    # one row per split
    numbered = lines.withColumn("inside", inside).join(F.broadcast(before), ["file", "block"])
    return numbered.select((F.col("before") + F.col("inside")).alias("line_no"), "value")


def read_factor_csv(spark: SparkSession, prefix: str) -> DataFrame:
    """Long ``(side, row, col, value, biased)`` table from a CSV pair; bias flags come from the name.

    Empty lines count for nothing; a value that is no number ends the job.
    """
    flags = dict(zip("WV", (part == "true" for part in prefix.split("_")[-2:])))
    sides = []
    for name in ("W", "V"):
        lines = numbered_lines(spark, f"{prefix}_{name}.csv")
        cells = lines.select(F.col("line_no").cast("int").alias("row"), F.posexplode(F.split(F.rtrim("value"), ",")).alias("col", "v"))
        sides.append(cells.select(F.lit(name).alias("side"), "row", "col", F.col("v").cast("double").alias("value"),
                                  F.lit(flags[name]).alias("biased")))
    return sides[0].unionByName(sides[1])


def write_sweep(sweep: DataFrame, path: str) -> None:
    sweep.write.option("sep", ";").option("header", True).csv(path)
