"""Archives: SQL, exact round trips and salvage of damaged files."""

import glob
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect

from duoscope.llm import REGISTRY, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, member int, payload string"


def made(n=8, size=300):
    """Records as bytes; payloads look like records in part."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        payload = rng.integers(0, 256, size).astype(np.uint8).tobytes() + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
        out.append(warc.record(i, f"http://a/{i}", payload, warc.base32_sha1(payload), None))
    return out


def ids(rows):
    return [int(r["record_id"].split(":")[2]) for r in rows if r["kind"] == "record"]


def gaps(rows):
    return [(r["offset"], r["length"]) for r in rows if r["kind"] == "gap"]


def read(data):
    return list(warc.salvaged(memoryview(data)))


def test_query(spark):
    fn, sql = REGISTRY["op13_warc"]
    assert compare(fn(spark, SF), connect(SF), sql) is None


@pytest.mark.parametrize("packed", [True, False])
def test_sound_archives(packed):
    parts = [warc.packed_member(r) if packed else r for r in made()]
    rows = read(b"".join(parts))
    assert ids(rows) == list(range(8)) and not gaps(rows)
    assert [r["length"] for r in rows] == [len(p) for p in parts]


@pytest.mark.parametrize("packed", [True, False])
def test_every_damaged_byte_costs_one_record(packed):
    """Any byte changed anywhere in the second record: all others are read, records and gaps cover the archive."""
    parts = [warc.packed_member(r) if packed else r for r in made(4)]
    whole = b"".join(parts)
    a, b = len(parts[0]), len(parts[0]) + len(parts[1])
    for at in range(a, b):
        data = bytearray(whole)
        data[at] ^= 0xA5
        rows = read(bytes(data))
        found = [r["offset"] for r in rows if r["kind"] == "record"]
        assert {0, b, b + len(parts[2])} <= set(found) <= {0, a, b, b + len(parts[2])}, at
        assert sum(r["length"] for r in rows) == len(whole), at
        if a not in found:  # bytes of headers may change without being noticed
            assert gaps(rows) == [(a, b - a)], at


@pytest.mark.parametrize("packed", [True, False])
def test_cuts_and_junk(packed):
    parts = [warc.packed_member(r) if packed else r for r in made(5)]
    junk = b"\x1f\x8b\x08 not a member \r\nWARC/1.1\r\nnor a record\r\n\r\n"
    data = junk + parts[0] + junk + parts[1] + parts[2][: len(parts[2]) // 2] + parts[3] + parts[4][:-7]
    rows = read(data)
    assert ids(rows) == [0, 1, 3]
    assert sum(r["length"] for r in rows) == len(data)
    assert [g[1] for g in gaps(rows)] == [len(junk), len(junk), len(parts[2]) // 2, len(parts[4]) - 7]


def test_many_records_in_one_member():
    records = made(5)
    broken = bytearray(b"".join(records))
    broken[len(records[0]) + len(records[1]) - 50] ^= 1
    rows = read(warc.packed_member(bytes(broken)))
    assert ids(rows) == [0, 2, 3, 4] and [r["inner_offset"] for r in rows if r["kind"] == "gap"] == [len(records[0])]


def test_no_record_at_all():
    assert read(b"") == [] and read(b"\0\0") == []
    assert gaps(read(b"nothing here")) == [(0, 12)]


def test_a_record_inside_a_damaged_payload_stays_inside():
    inner = made(1)[0]
    outer = bytearray(warc.record(7, None, b"x" * 50 + b"\n" + inner, "A" * 32, None))
    data = bytes(outer) + made(2)[1]
    rows = read(data)  # the payload digest is wrong
    assert ids(rows) == [1] and gaps(rows) == [(0, len(outer))]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip_of_edges(spark, tmp_path, compress):
    big = "long page ä\r\n\r\n" * 1_500_000
    rows = [(3, "http://a/b c?ä", "twin"), (2, None, "twin"), (2, "http://b", "twin"), (None, "u", "twin"), (None, None, "alone"),
            (None, "v", "alone"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "\x00\x1f\u008b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, compress=compress)
    found = warc.read_archives(spark, path)
    assert warc.gap_log(found).count() == 0
    got = {}
    for r in found.collect():
        got.setdefault(r.record_id.split(":")[2], []).append((r.record_type, r.refers_to and r.refers_to.split(":")[2], r.payload_bytes,
                                                             None if r.payload is None else bytes(r.payload).decode()))
    assert got["2"] == [("response", None, 4, "twin")] * 2 and got["3"] == [("revisit", "2", 4, None)]
    assert sorted(got[""], key=str) == sorted([("revisit", "2", 4, None)] + [("response", None, 5, "alone")] * 2, key=str)
    assert got["4"] == [("response", None, 0, "")] and got["5"] == [("revisit", "4", 0, None)]
    assert got["6"][0][3] == big and got["7"][0][3] == "\x00\x1f\u008b"
    uris = {r.target_uri for r in found.collect()}
    assert {"http://a/b%20c?%C3%A4", "http://b", None} <= uris


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_damage_in_files_is_logged(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages.coalesce(1), path)
    name = max(glob.glob(path + "/part-*"), key=os.path.getsize)
    data = bytearray(open(name, "rb").read())
    for at in range(5_000, len(data), 9_000):
        data[at:at + 3] = b"???"
    os.makedirs(tmp_path / "broken")
    (tmp_path / "broken" / "a.warc.gz").write_bytes(bytes(data))
    found = warc.read_archives(spark, str(tmp_path / "broken")).cache()
    log = warc.gap_log(found).collect()
    sums = found.agg(F.sum("length").alias("n")).first().n
    kept = {r.record_id for r in found.where("kind = 'record'").collect()}
    whole = {r.record_id for r in warc.read_archives(spark, path).collect()}
    assert log and sums == len(data) and kept < whole and len(kept) >= len(whole) - len(range(5_000, len(data), 9_000))
    assert all(r.reason for r in log)


def test_python_gzip_reads_the_archives(spark, tmp_path):
    import gzip

    path = str(tmp_path / "w")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, path)
    text = b"".join(gzip.open(f).read() for f in glob.glob(path + "/part-*"))
    assert text.count(b"\r\nWARC-Type: re") == pages.count()
    assert zlib.crc32(text)
