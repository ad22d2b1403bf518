"""Exact duplicates, line chunks, token counts, mixing, licenses, language and the pipeline."""

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect

import corpus_pipeline
from duoscope.llm import REGISTRY, exact_dup, langid, licenses, line_chunks, mixing, token_counts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_queries_with_sql(spark, name):
    fn, sql = REGISTRY[name]
    assert compare(fn(spark, SF), connect(SF), sql) is None


# -- exact duplicates --------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [3, 20, 10_000])
def test_directory_splits_until_nothing_is_overfull(spark, capacity):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    starts = exact_dup.directory(keys, capacity)
    found = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    load = np.bincount(np.searchsorted(starts, found, side="right") - 1, minlength=len(starts))
    assert starts[0] == 0 and load.max() <= capacity and load.sum() == 500


def test_exact_edges(spark, edge):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dup.deduplicate(edge, 2).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 2, True), (None, None, 1, True)} <= got
    assert exact_dup.deduplicate(edge.limit(0)).count() == 0


def test_equal_keys_are_told_apart_by_bytes(spark):
    """With one key for all texts the chains decide."""
    rows = spark.createDataFrame([(i, f"t{i % 3}".encode(), 5, hashlib.sha256(f"t{i % 3}".encode()).digest()) for i in range(9)],
                                 "doc_id long, text binary, key long, sha binary")
    got = exact_dup._entries(rows, np.array([0], np.uint64)).collect()
    assert sorted(r.place for r in got) == [0, 1, 2] and {r.group_size for r in got} == {3}
    assert {r.keep_id for r in got} == {6, 7, 8}


# -- line chunks -------------------------------------------------------------------------------
def test_line_edges(spark, edge):
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(edge).collect()}
    assert got[1].n_lines == 1 and got[1].text == "" and got[8].n_removed_lines == 0
    assert got[5].n_lines == 3001
    assert line_chunks.remove_repeated_chunks(edge.limit(0)).count() == 0


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"line number {i} of the passage" for i in range(40))
    rows = [(1, f"intro\n{passage}\nend one"), (2, f"other\nstart\nhere\n{passage}\nend two"), (3, "nothing\nshared")]
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed_lines == 0 and got[3].n_removed_lines == 0 and got[2].n_removed_lines >= 25
    assert got[2].text.split("\n")[0] == "other" and got[2].text.endswith("end two")


def foreign_passages():
    """Passages of 2 to 6 lines, each twice, in lines that occur once."""
    rows, where = [], {}
    for n in range(2, 7):
        for v in range(30):
            passage = [f"passage {n} {v} line {i}" for i in range(n)]
            for copy in range(2):
                doc = len(rows)
                before, after = ([f"foreign {doc} {side} {i}" for i in range(1 + (v + copy) % 3)] for side in ("a", "b"))
                rows.append((doc, "\n".join([*before, *passage, *after])))
                where[doc] = (n, copy, "\n".join(before + after))
    return rows, where


def test_short_passages_in_foreign_surroundings(spark):
    rows, where = foreign_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_chunks.remove_repeated_passages(df).collect():
        n, copy, rest = where[r.doc_id]
        assert (r.n_removed_lines, r.n_removed_passages) == ((n, 1) if copy else (0, 0)), r
        assert r.text == (rest if copy else rows[r.doc_id][1])


def test_passages_take_what_chunks_take_and_keep_every_line(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(docs).collect()}
    passages = {r.doc_id: r for r in line_chunks.remove_repeated_passages(docs).collect()}
    assert all(passages[i].n_removed_lines >= r.n_removed_lines for i, r in chunks.items())
    assert {x for r in docs.collect() for x in (r.text or "").split("\n")} - {""} == {
        x for r in passages.values() for x in r.text.split("\n")} - {""}
    got = {r.doc_id: r for r in line_chunks.remove_repeated_passages(edge).collect()}
    assert got[1].n_lines == 1 and got[1].text == "" and got[8].n_removed_lines == 0
    assert (got[5].n_lines, got[5].n_removed_lines) == (3001, 2999)
    assert line_chunks.remove_repeated_passages(edge.limit(0)).count() == 0


# -- token counts ------------------------------------------------------------------------------
def brute_count(word, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        last = word[end - 1]
        n = len(last.encode())
        options = [(best[end - 1][0] + n * byte_score, -(best[end - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in scores]
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


@pytest.mark.parametrize("bounds", [(600_000, 400_000), (50, 20)])
def test_token_counts(spark, bounds):
    import public_tokenizers

    scores, byte_score = token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.UnigramTrie(scores, byte_score, *bounds)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        text = (r.text or "")[:3000] + " 漢字 x\tü"
        words = text.split()
        assert trie.count(text) == (len(words), sum(brute_count("▁" + w, scores, byte_score) for w in words))


def test_query_counts_whole_texts(spark):
    import public_tokenizers

    scores, byte_score = token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
    known = {}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in token_counts.op7_token_counts(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        for w in set(text.split()) - known.keys():
            known[w] = brute_count("▁" + w, scores, byte_score)
        words = text.split()
        assert (got[i].n_pre_tokens, got[i].n_tokens) == (len(words), sum(known[w] for w in words))


def test_token_count_edges(spark, edge):
    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in token_counts.token_counts(edge).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4][0] == 1 and got[5][0] == 30_000 and got[6] == got[7]
    assert token_counts.token_counts(edge.limit(0)).count() == 0


# -- mixing ------------------------------------------------------------------------------------
def test_targets_share_out_what_caps_leave(spark):
    rows = [(f"s{i}", n) for i, n in enumerate([1, 1000, 1000, 5, 700, 3])] + [(None, 900)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert sum(r.target for r in got.values()) == pytest.approx(sum(n for _, n in rows))
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got.values()) and got["s0"].target == 3
    assert got["s4"].target / 2 == pytest.approx(got["s1"].target / 2) and got[None].target == pytest.approx(got["s1"].target / 2)


def test_mix_edges(spark, edge):
    got = mixing.mix(edge).collect()
    assert len(got) == 10 and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0} and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mix(edge.limit(0)).count() == 0
    one = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "concat('s', id % 3) AS source")
    taken = {r.source: (r.n, r.t) for r in mixing.mix(one).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t")).collect()}
    assert all(abs(n - t) <= 10 for n, t in taken.values())


# -- licenses ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licenses(spark, model, edge):
    assert model["held_out_accuracy"] > 0.9
    filler = "erinst thandon resh of the onle " * 30
    rows = [(i, f"{filler}\n{notice}\n{filler}") for i, (notice, *_) in enumerate(licenses.TEMPLATES.values())]
    rows += [(100, f"{filler} {licenses.TEMPLATES['MIT'][1]} {filler}"), (101, filler), (102, "the license of the version under general terms")]
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(licenses.TEMPLATES))] == [[f] for f in licenses.TEMPLATES]
    assert got[100] == ["MIT"] and got[101] == [] and got[102] == []
    assert {r.n_licensed for r in licenses.scan(edge, model).collect()} == {0}
    assert licenses.scan(edge.limit(0), model).count() == 0


#: A notice of every family as source files have it.
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                  "with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met:",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license "
             "visit the site of Creative Commons.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy "
                "of this license visit the site of Creative Commons.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
           "Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at mozilla.org.",
}


def wrapped(notice, width, mark):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(notice, width))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", "REM ", "dnl "])
def test_wrapped_notices_are_passages(mark):
    for notice in NOTICES.values():
        (whole, *_) = licenses.passages(notice)
        assert whole in licenses.passages(f"int main\r\n\r\n{wrapped(notice, 60, mark)}\n{mark}\nreturn")


def wrapped_notices():
    filler = "erinst thandon resh of the onle " * 30
    rows, want = [], {}
    for family, notice in NOTICES.items():
        for width in (50, 70, 80):
            for mark in ("", "# ", " * ", "// ", "-- "):
                for around in ("\n\n", "\n"):
                    want[len(rows)] = family
                    rows.append((len(rows), f"{filler}{around}{wrapped(notice, width, mark)}{around}{filler}"))
    return rows, want


def test_wrapped_notices(spark, model):
    rows, want = wrapped_notices()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(rows[i][1], got[i].families) for i in want if got[i].families != [want[i]]] == []
    assert all(got[i].n_licensed >= 1 for i in want)


#: Notices near the families that are of none of them; the lower ones are not among those trained on.
FOREIGN = [
    *licenses.NEIGHBOURS,
    "This file is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "This work is licensed under the GNU Affero General Public License, version 3, or any later version.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
]


def test_neighbours_of_families_are_unknown(spark, model):
    filler = "erinst thandon resh of the onle " * 30
    rows = [f"{a}{wrapped(n, w, '# ')}{b}" for n in FOREIGN for w in (60, 500) for a, b in (("", ""), (f"{filler}\n", f"\n{filler}"))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [(rows[r.doc_id], r.families) for r in licenses.scan(df, model).collect() if r.families] == []


# -- language ----------------------------------------------------------------------------------
def test_language_held_out(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    found = langid.predict(docs, model).where(langid.held_out(F.col("row.doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("row.lang")).cast("int")).alias("a")).first().a
    assert right > 0.97 and found.where("score < 0 OR score > 1").count() == 0
    got = {r.row.doc_id: r.lang for r in langid.predict(edge, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in model["langs"] and got[5] == "en"
    far = spark.createDataFrame([(1, "щука жаба дюжина " * 20)], "doc_id long, text string")
    assert langid.predict(far, model).first().rejected
    assert {r.lang for r in langid.predict(edge, langid.fit(docs.limit(0))).collect()} == {"und"}


# -- pipeline ----------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == columns
            now = [r.doc_id for r in docs.collect()]
            assert set(now) <= before and (name == "mixing" or len(now) == len(set(now)))
            before = set(now)
    # the last stage against the tokenizer, over the mixed documents
    from test_token_blocks import expected

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "mixing")).collect())
    assert sorted(map(tuple, docs.collect())) == sorted(expected(rows))
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_edges(spark, edge, tmp_path):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
