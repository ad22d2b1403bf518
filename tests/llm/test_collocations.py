"""Automata and phrases against plain counting and SQL."""

import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect

from duoscope.llm import REGISTRY, collocations
from duoscope.llm import transducers as tr

DOCS = "text string, lang string, size int, part string, a long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(texts, longest=4):
    out = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                out.update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return out


def strongest(rows, least, top=2000):
    """The contract, word by word."""
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = plain([t for t, g in rows if (g or "und") == lang])
        n = sum(c for p, c in f.items() if " " not in p)
        candidates = {p: c for p, c in f.items() if " " in p and c >= least}
        inside = {}
        for p, c in candidates.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    q = " ".join(w[i:i + m])
                    inside[q] = max(inside.get(q, 0), c)
        kept = []
        for p, a in candidates.items():
            w = p.split(" ")
            score, _, left, right = min((2_000_000 * a // (f[x] + f[y]), k, f[x], f[y]) for k in range(1, len(w))
                                        for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            if not 100 * inside.get(p, 0) >= 80 * a:
                kept.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def made(seed, n, vocabulary=12, pieces=6):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "ÄB", "é", "x-y"]
    odds = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(0, 9), p=odds / odds.sum())) + rng.choice([". ", ",", "\n", "\t", " ! "])
            for _ in range(n * pieces)]


def tree_of(texts, longest=4):
    block = b".".join(t.encode().translate(collocations.SPACE) for t in texts)
    words, ids, new = collocations.numbered(block, 0)
    return tr.built(words, ids, new, longest)


def as_counter(tree):
    return Counter({p.decode(): int(w) for phrase, weight in tr.sequences_of(tree) for p, w in zip(phrase, weight) if w})


@pytest.mark.parametrize("longest", [2, 4, 5])
def test_automata_count_store_and_add(longest):
    texts = [made(s, 30) for s in range(4)]
    trees = [tree_of(t, longest) for t in texts]
    for t, tree in zip(texts, trees):
        assert as_counter(tree) == plain(t, longest) == as_counter(tr.loaded(tr.stored(tree)))
    total = tr.union([tr.loaded(tr.stored(t)) for t in trees])
    wanted = plain(sum(texts, []), longest)
    assert as_counter(total) == wanted
    assert as_counter(tr.pruned(total, 5)) == Counter({p: c for p, c in wanted.items() if c >= 5})


def test_equal_endings_are_shared():
    tree = tree_of([f"a{i} x y z" for i in range(50)])
    assert [len(s[0]) for s in tr.shared(tree)] == [1, 4, 3, 2]  # all a are one state
    assert as_counter(tr.loaded(tr.stored(tree)))["a7 x y z"] == 1


def test_hashes_of_states_decide_nothing(monkeypatch):
    monkeypatch.setattr(tr, "MIX", (np.uint64(0), np.uint64(0)))
    tree = tree_of(made(1, 40))
    assert as_counter(tr.loaded(tr.stored(tree))) == as_counter(tree)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_by_prefix_range(seed):
    texts = made(seed, 30)
    tree, wanted = tree_of(texts), plain(texts)
    every = sorted(tuple(p.encode().split()) for p in wanted)
    rng = np.random.default_rng(seed)
    bounds = sorted({every[i] for i in rng.integers(0, len(every), 7)} | {(b"w1", b"zz"), (b"",), (b"zzz", b"a"), (b"w0", b"w0", b"w0", b"w0", b"w1")})
    parts = tr.cut(tree, bounds)
    assert len(parts) == len(bounds) + 1
    total = Counter()
    for i, part in enumerate(parts):
        if part is not None:
            own = as_counter(tr.loaded(tr.stored(part)))
            low, high = bounds[i - 1] if i else (), bounds[i] if i < len(bounds) else (b"\xff",)
            assert all(low <= tuple(p.encode().split()) < high for p in own)
            total += own
    assert total == wanted
    assert as_counter(tr.union([p for p in parts if p is not None])) == wanted


def test_composition():
    texts = made(3, 40)
    tree, wanted = tree_of(texts), plain(texts)
    asked = [tuple(p.encode().split()) for p in wanted] + [(b"no",), (b"w0", b"no"), (b"no", b"w0", b"w1"), (b"w0",)]
    assert tr.composed(asked, tree).tolist() == [wanted[b" ".join(s).decode()] for s in asked]
    assert tr.composed(asked, tr.pruned(tree, 10**9)).tolist() == [0] * len(asked)


@pytest.mark.parametrize("size", [7, 20, 64, 1000])
def test_parts_of_long_texts(size):
    texts = [" ".join(made(5, 40)), "a " * 300, "b" * 500, " x" * 40 + "y" * 200 + " z z z z z. q", "....", ". a b c d e f g h . i j", ""]
    for text in texts:
        trees = []
        for part, old in collocations.parts_of(text.encode().translate(collocations.SPACE), size, 3):
            words, ids, new = collocations.numbered(part, old)
            if len(words):
                trees.append(tr.built(words, ids, new, 4))
        assert (as_counter(tr.union(trees)) if trees else Counter()) == plain([text])


@pytest.mark.parametrize("range_words, size", [(40, 100), (400, 3000), (10**6, 10**6)])
def test_phrases(spark, range_words, size):
    texts = made(8, 150)
    rows = [(t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts)] + [(None, "en"), ("", None), ("   ", "fr"), (texts[0], "en")]
    rows += [("one very long piece without any end " * 200, "en")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(3)
    got = collocations.collocations(df, least=5, top=40, range_words=range_words, size=size)
    assert sorted(tuple(r) for r in got.collect()) == strongest(rows, 5, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_large_counts(spark):
    """Products beyond 64 bits."""
    rows = [("en", "a b", 2, 4 * 10**17), ("en", "a b c", 3, 10**17)]
    found = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    assert [r.phrase for r in collocations.outermost(found).orderBy("phrase").collect()] == ["a b", "a b c"]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    fn, sql = REGISTRY["op12_collocations"]
    folder = f"/root/testdata/{sf}"
    assert compare(fn(spark, folder), connect(folder), sql) is None
