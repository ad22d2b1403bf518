"""The automaton against a search of every window in every document."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duoscope.llm import decontaminate as dc


def brute(docs, items, window=10):
    def windows(words):
        return {tuple(words[i:i + window]) for i in range(len(words) - window + 1)} if len(words) >= window else ({tuple(words)} if words else set())

    per_item = {name: windows(dc.words_of(text)) for name, text in items}
    out = {}
    for doc_id, text in docs:
        words = dc.words_of(text)
        hit, found = set(), set()
        for name, some in per_item.items():
            for size in {len(w) for w in some}:
                for i in range(len(words) - size + 1):
                    if tuple(words[i:i + size]) in some:
                        hit.update(range(i, i + size))
                        found.add(str(name))
        out[doc_id] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_words_lower_ascii_only():
    assert dc.words_of("Äb-C ÀÉ_x9") == ["Äb".encode(), b"c", "ÀÉ".encode(), b"x9"]


@pytest.mark.parametrize("seed", range(30))
def test_scan_on_small_alphabets(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 14)))) for i in range(6)]
    docs = [(i, " ".join(rng.choices("abcd", weights=[5, 5, 5, 1], k=200))) for i in range(3)]
    automaton = dc.SuffixAutomaton([(n, dc.words_of(t)) for n, t in items], 5)
    want = brute(docs, items, 5)
    for doc_id, text in docs:
        spans, found = automaton.scan(dc.words_of(text))
        names = {str(automaton.names[i]) for i in found}
        assert (sum(b - a for a, b in spans), len(names)) == want[doc_id][1:3]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in dc.op4_decontaminate(spark, sf).collect()}
    assert got == brute(docs, items)
    assert any(r[4] for r in got.values())


def test_blocks_of_items_agree(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = dc.find_spans(docs, items).select("row.doc_id", "spans", "items").orderBy("doc_id").collect()
    many = dc.find_spans(docs, items, block_bytes=2000).select("row.doc_id", "spans", "items").orderBy("doc_id").collect()
    assert one == many


def test_edges_and_cutting(spark, edge):
    items = spark.createDataFrame([(1, "the dog ran the cat"), (2, None), (3, "!!")], "item_id long, text string")
    got = dc.contamination(edge, items).where("contaminated").collect()
    assert [(r.doc_id, r.n_items) for r in got] == [(5, 1)]
    cut = dc.decontaminate(edge, items, max_coverage=0.4)
    assert cut.columns == edge.columns and cut.count() == 9  # half of the words of document 5 are hit
    assert dc.decontaminate(edge, items, max_coverage=1.0).count() == 10
    assert dc.contamination(edge.limit(0), items).count() == 0
    assert dc.contamination(edge, items.limit(0)).where(F.col("contaminated")).count() == 0
    assert dc.cut_words("Say: one, two three. End", [(1, 3)]) == "Say:  three. End"


def test_items_without_names_and_with_the_same(spark):
    words = [f"word{i}" for i in range(60)]
    items = [("a", " ".join(words[:12])), ("a", " ".join(words[20:32])), (None, " ".join(words[40:52])), ("None", "other words altogether")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[40:52])), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in dc.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    import hashlib

    assert (got[1].n_items, got[1].items_sha256) == (3, hashlib.sha256(b"a,a").hexdigest())
    assert (got[2].n_items, got[2].items_sha256, got[2].contaminated) == (1, hashlib.sha256(b"").hexdigest(), True)
    assert got[3].n_items == 0
