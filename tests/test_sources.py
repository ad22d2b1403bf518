import os

import pytest
from pyspark.sql import functions as F

from duoscope.operators import encode
from duoscope.operators.joins import join_sides
from duoscope.sources import tables, text

ITEMS = [
    "movieId,title,genres",
    '1,"Two, and more (1995)",Comedy|Drama',
    "2,No year,(no genres listed)",
    "3,Odd ) first (x,Action",
    "4,Old (a) (1950),Sci-Fi",
    "5,Twice (1999) tail (2001),War|Action",
]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_items_split_at_outer_commas(spark, tmp_path):
    items = text.read_items(spark, write(tmp_path / "i.csv", ITEMS))
    rows = {r.item_id: r for r in items.collect()}
    assert len(rows) == 5 and rows[1].title == '"Two, and more (1995)"' and rows[1].genres == "Comedy|Drama"
    years = {r.item_id: r.year for r in encode.parsed_items(items).collect()}
    assert years == {4: 1950, 5: 2001} | {1: years[1]}
    scaled = {r.item_id: r.year_scaled for r in encode.scaled_years(encode.parsed_items(items)).collect()}
    assert scaled[4] == 0.0 and scaled[5] == 1.0


def test_year_before_closing_quote(spark, tmp_path):
    items = text.read_items(spark, write(tmp_path / "i.csv", ITEMS))
    assert {r.item_id: r.year for r in encode.parsed_items(items).collect()}[1] == 1995


def test_genres_match_as_substrings(spark, tmp_path):
    items = text.read_items(spark, write(tmp_path / "i.csv", ITEMS))
    hot = {r.item_id: [i for i, b in enumerate(r.bin) if b] for r in encode.parsed_items(items).collect()}
    assert hot == {1: [5, 8], 4: [16], 5: [1, 18]}


def test_rating_of_exactly_four_is_positive(spark, tmp_path):
    path = write(tmp_path / "r.csv", ["userId,movieId,rating,timestamp", "1,2,4.0,9", "1,3,3.5,9"])
    got = encode.with_outcome(text.read_ratings(spark, path)).orderBy("item_id").collect()
    assert [r.outcome for r in got] == [True, False]


def test_names_and_pairs(spark, tmp_path):
    names = text.read_tag_names(spark, write(tmp_path / "n.csv", ["tagId,tag", "1,a, b", "2,c"]))
    assert {r.pos: r.name for r in names.collect()} == {0: "a, b", 1: "c"}
    pairs = text.read_id_map(spark, write(tmp_path / "p.txt", ["(12.0,3)", "(7,0)"]))
    assert {r.item_id: r.idx for r in pairs.collect()} == {12: 3, 7: 0}


def test_dyads_round_trip_and_width_check(spark, tmp_path):
    schema = ", ".join(f"{s}_{b} {t}" for s in tables.SIDES for b, t in (
        ("bin", "array<boolean>"), ("tri", "array<tinyint>"), ("num", "array<double>"))) + ", label boolean"
    row = (None, [1, 0, -1], None, [True, False], None, [0.5], True)
    tables.write_dyads(spark.createDataFrame([row], schema), str(tmp_path / "d"))
    assert tuple(tables.read_dyads(spark, str(tmp_path / "d")).first()) == row
    from pyspark.ml.linalg import Vectors

    bad = spark.createDataFrame([(1.0, Vectors.dense([1.0, 2.0]))], ["label", "features"])
    bad.write.mode("append").parquet(str(tmp_path / "d/rows"))
    with pytest.raises(Exception, match="dyad width"):
        tables.read_dyads(spark, str(tmp_path / "d")).collect()


def test_save_once_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "m")
    tables.save_once(spark.range(3), path)
    assert tables.save_once(spark.range(9), path).count() == 3


def test_sides_of_a_hot_user(spark):
    dyads = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("user_id"), (F.col("id") % 50).alias("item_id"), "id")
    users = spark.range(400).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("x"))
    items = spark.range(40).select(F.col("id").alias("item_id"), (F.col("id") * 3).alias("y"))
    both = join_sides(dyads, users, items)
    assert both.where("x <> user_id * 2 or y <> item_id * 3").isEmpty()
    assert both.count() == dyads.where("user_id < 400 and item_id < 40").count()


@pytest.mark.parametrize("parts", [1, 8, 256, None])
def test_dense_index_is_the_global_rank(spark, parts):
    counts = spark.range(3000).select(F.col("id").alias("item_id"), F.pmod(F.hash("id"), F.lit(5)).cast("long").alias("n"))
    got = {r.item_id: r.idx for r in encode.dense_index(counts, 2, parts).collect()}
    rows = [(r.n, r.item_id) for r in counts.where("n >= 2").collect()]
    assert got == {i: k for k, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}


def test_dense_index_of_nothing_and_its_plan(spark):
    counts = spark.range(300).select(F.col("id").alias("item_id"), (F.col("id") % 7).alias("n"))
    assert encode.dense_index(counts, 100).count() == 0
    plan = encode.dense_index(counts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def test_bad_lines_end_a_count_too(spark, tmp_path):
    (tmp_path / "r").write_text("userId,movieId,rating,timestamp\n1,2,3.5,0\n1,2\n4,5,4.0,0\n")
    with pytest.raises(Exception, match="not a line of ratings"):
        text.read_ratings(spark, str(tmp_path / "r")).count()
    with pytest.raises(Exception, match="not a line of ratings"):
        text.read_ratings(spark, str(tmp_path / "r")).select("user_id").collect()


@pytest.mark.parametrize("parts", [1, 4, None])
def test_factor_csv_of_several_files(spark, tmp_path, parts):
    cells = spark.range(11 * 7).select(F.explode(F.array(F.lit("W"), F.lit("V"))).alias("side"), (F.col("id") / 7).cast("int").alias("row"),
                                       (F.col("id") % 7).cast("int").alias("col"), F.round(F.rand(3), 9).alias("value"))
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    full = tables.write_factor_csv(cells, str(tmp_path / "u"), False, True, parts)
    if parts:
        assert len([f for f in os.listdir(f"{full}_W.csv") if f.startswith("part-")]) == parts
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")  # files are split, too
    try:
        back = {(r.side, r.row, r.col): (r.value, r.biased) for r in tables.read_factor_csv(spark, full).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert back == {(r.side, r.row, r.col): (r.value, r.side == "V") for r in cells.collect()}


def test_user_vectors_and_leak_option(spark):
    rated = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 99, True), (3, 11, True), (3, 11, False)],
                                  "user_id long, item_id long, outcome boolean")
    mapping = spark.createDataFrame([(11, 0), (10, 1), (12, 2)], "item_id long, idx int")
    users = encode.user_vectors(rated, mapping)
    assert {r.user_id: r.tri for r in users.collect()} == {1: [-1, 1, 0], 3: [1, 0, 0]}
    hidden = users.where("user_id = 1").select(encode.without_item(F.col("tri"), F.lit(1)).alias("t")).first()
    assert hidden.t == [-1, 0, 0]


def test_sparse_dyads_read_like_dense_ones(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, True, [1, 3, 5], [-1.0, 1.0, 0.5])],
                                 "user_id long, item_id long, label boolean, indices array<int>, values array<double>")
    tables.write_sparse_dyads(rows, {"left_tri": 3, "right_bin": 2, "right_num": 1}, str(tmp_path / "d"))
    assert tuple(tables.read_dyads(spark, str(tmp_path / "d")).first()) == (None, [0, -1, 0], None, [True, False], None, [0.5], True)


def test_headers_go_by_equality_in_every_part(spark, tmp_path):
    folder = tmp_path / "ratings"
    folder.mkdir()
    write(folder / "part-0.csv", ["userId,movieId,rating,timestamp", "1,2,4.0,9"])
    write(folder / "part-1.csv", ["3,4,2.5,9", "5,6,1.0,9"])
    assert {r.user_id for r in text.read_ratings(spark, str(folder)).collect()} == {1, 3, 5}


@pytest.mark.parametrize("read, lines", [
    (text.read_ratings, ["3,12,x,0"]), (text.read_ratings, ["3,12"]), (text.read_items, ["1,no genres"]),
    (text.read_tag_names, ["no comma"]), (text.read_cluster_sizes, ["(1,2", "(3,4)"]), (text.read_tags, ["1,2,3,4"])])
def test_bad_lines_fail(spark, tmp_path, read, lines):
    with pytest.raises(Exception):
        read(spark, write(tmp_path / "bad.csv", lines)).collect()


def test_save_once_never_shows_half_a_table(spark, tmp_path):
    path = tmp_path / "m"
    spark.range(1000).write.parquet(f"{path}-0123456789ab")  # what a job that was broken off leaves
    assert tables.save_once(spark.range(9), str(path)).count() == 9
    (path / "_SUCCESS").unlink()  # a complete table where markers are switched off
    assert tables.save_once(spark.range(5), str(path)).count() == 9


def test_second_writer_leaves_the_first_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    name = tables.uuid.uuid4

    def slow():
        monkeypatch.undo()
        tables.save_once(spark.range(2), path)  # another writer is done first
        return name()

    monkeypatch.setattr(tables.uuid, "uuid4", slow)
    assert tables.save_once(spark.range(4), path).count() == 2
    assert [f for f in os.listdir(path) if not f.startswith((".", "_", "part-"))] == []


def test_one_common_year_scales_to_zero(spark, tmp_path):
    items = text.read_items(spark, write(tmp_path / "i.csv", ["1,A (1990),Drama", "2,B (1990),Comedy"]))
    assert [r.year_scaled for r in encode.scaled_years(encode.parsed_items(items)).collect()] == [0.0, 0.0]
