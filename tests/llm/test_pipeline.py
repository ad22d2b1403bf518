"""Every stage of the pipeline against a plain version of it, on the rows its predecessor kept."""

import re
from collections import Counter

import duckdb
import pytest
from test_near_dup import brute
from test_token_blocks import expected

import corpus_pipeline
from duoscope.llm import langid, mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name: (rows before, rows after)."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = (docs, after)
        docs = after
    return out


def test_language(spark, stages):
    before, after = stages["language"]
    found = langid.predict(before, langid.fit(before))
    wanted = sorted(r.row.doc_id for r in found.where("not rejected").collect())
    assert sorted(r.doc_id for r in after.collect()) == wanted
    clean = [r for r in before.collect() if len(r.text) > 300]
    assert len([r for r in clean if r.doc_id in set(wanted)]) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    wanted = sorted(d for d, n, component in brute(rows, 5, 80) if n == 0 or d == component)
    assert sorted(r.doc_id for r in after.collect()) == wanted
    texts = dict(rows)
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = WORD.findall(lowered(r.text or ""))
        if words:
            windows |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))}
    wanted = {}
    for r in before.collect():
        raw, low = r.text.encode(), lowered(r.text)
        places = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in places]
        hit = [False] * len(words)
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit[i:i + size] = [True] * size
        if sum(hit) * 2 > len(words):
            continue
        kept, at, i = b"", 0, 0
        while i < len(words):
            if hit[i]:
                j = i
                while j + 1 < len(words) and hit[j + 1]:
                    j += 1
                kept += raw[at:places[i][0]]
                at, i = places[j][1], j
            i += 1
        wanted[r.doc_id] = (kept + raw[at:]).decode()
    assert {r.doc_id: r.text for r in after.collect()} == wanted


def test_mixing(stages, tmp_path):
    before, after = stages["mixing"]
    before.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = [c[0] for c in con.execute(mixing.OP8_SQL).description]
    rows = [dict(zip(names, r)) for r in con.execute(mixing.OP8_SQL).fetchall()]
    wanted = Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]})
    assert Counter(r.doc_id for r in after.collect()) == wanted
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_tokens(stages):
    before, after = stages["tokens"]
    assert sorted(map(tuple, after.collect())) == sorted(expected(sorted((r.doc_id, r.text) for r in before.collect())))


def test_other_texts_of_an_id_stay(spark):
    """Rows go by id and text: a near copy takes no other text of its id with it, and copies without id are one row."""
    a = " ".join(f"w{i % 37}x{i}" for i in range(120))
    b = a.replace("w5x5 ", "changed ")
    other = " ".join(f"v{i}" for i in range(120))
    rows = [(1, a), (5, b), (5, other), (None, a), (None, a), (7, other + " more"), (7, other + " more"), (8, "  "), (8, "  "), (9, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (5, other), (8, "  "), (8, "  "), (9, None)], key=str)
    lone = [(None, a), (None, b), (None, a)]
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame(lone, "doc_id long, text string"), SF).count() == 1
