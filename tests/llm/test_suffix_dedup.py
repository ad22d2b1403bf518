"""Removed bytes against a table of all strings."""

import hashlib
import random

import pytest

from duoscope.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for doc_id, text in rows:
        raw, order = (text or "").encode(), sd.LAST if doc_id is None else doc_id
        for i in range(len(raw) - sd.LENGTH + 1):
            s = raw[i:i + sd.LENGTH]
            first[s] = min(first.get(s, order), order)
    out = []
    for doc_id, text in rows:
        raw, order = (text or "").encode(), sd.LAST if doc_id is None else doc_id
        gone = bytearray(len(raw))
        for i in range(len(raw) - sd.LENGTH + 1):
            if first[raw[i:i + sd.LENGTH]] < order:
                gone[i:i + sd.LENGTH] = b"\1" * sd.LENGTH
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    """Documents put together from shared passages of 45 to 200 bytes, periodic strings and their own text."""
    rng = random.Random(seed)
    letters = "abcdé "
    shared = ["".join(rng.choices(letters, k=rng.randint(45, 200))) for _ in range(6)] + ["ab" * 60, "x" * 130]
    own = lambda: "".join(rng.choices(letters, k=rng.randint(0, 90)))
    return [(i, "".join(own() + rng.choice(shared) for _ in range(rng.randint(0, 5))) + own()) for i in rng.sample(range(1000), 60)]


@pytest.mark.parametrize("often", [3, 50_000])
@pytest.mark.parametrize("group_bytes", [2_000, 1 << 22])
def test_shared_passages(spark, monkeypatch, often, group_bytes):
    monkeypatch.setattr(sd, "OFTEN", often)
    rows = passages(often)
    rows += [(7777, rows[0][1]), (7778, rows[0][1]), (None, rows[1][1]), (None, rows[1][1])]
    got = sd.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op9_suffix_dedup(spark, sf).collect()), key=repr) == brute(rows)


def test_edges(spark, edge):
    got = sorted(map(tuple, sd.repeated_bytes(edge).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert sd.repeated_bytes(edge.limit(0)).count() == 0
