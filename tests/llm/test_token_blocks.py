"""Token shards: round trips, the piece cut, whole queries against the tokenizer."""

import cProfile
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duoscope.llm import token_blocks as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def encoder():
    return tb.PieceEncoder(PATH, limit=50)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(7, 900, n)).astype(np.uint32)
    lengths = np.array([n], np.uint32)
    got, back = tb.decode_shard(tb.encode_shard(ids, lengths))
    assert (got == ids).all() and (back == lengths).all()


def test_exceptions_make_blocks_small():
    ids = np.full(2560, 3, np.uint32)
    ids[::100] = 4_000_000_000
    data = tb.encode_shard(ids, np.array([2560], np.uint32))
    assert len(data) < 600 and (tb.decode_shard(data)[0] == ids).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9.,!'\n\t\r  é漢😀\0<|endoftext|>"), max_size=60) | st.text(max_size=60))
def test_pieces_equal_whole_texts(encoder, text):
    whole = Tokenizer.from_file(PATH)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_those_of_the_plain_call(encoder):
    text = "one <|endoftext|> two"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == [505, 220, 50256, 734]
    assert np.frombuffer(encoder.encode(["a", text, "b c"])[1], "<u4").tolist() == [505, 220, 50256, 734]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9.,;!'\n\té漢.,  \0"), max_size=30), max_size=30), st.integers(1, 30))
def test_columns_equal_whole_texts(encoder, whole, texts, limit):
    """Texts of several turns, also when nearly all pieces are forgotten between them."""
    encoder.limit = limit
    for some in (texts, texts[::-1], ["", *texts, ""]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == [whole.encode(t, add_special_tokens=False).ids for t in some]


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.n += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_pieces_are_encoded_once():
    """Of many distinct pieces in many slices, each goes to the tokenizer once, with a mark or without."""
    texts = [" ".join(f"{w}x, {w}x {w}x." for w in range(a, a + 10_000)) for a in range(100_000, 300_000, 10_000)]
    encoder = tb.PieceEncoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    first = [encoder.encode([t]) for t in texts]
    assert encoder.tokenizer.n < 200_000 * len(" 100000x") + 1_000
    encoder.tokenizer.n = 0
    assert [encoder.encode([t]) for t in texts] == first and encoder.tokenizer.n == 0


def test_no_python_call_per_piece(encoder):
    """Python's work does not grow with the pieces of a slice."""
    texts = [" ".join(f"v{i * 500 + j}q" for j in range(500)) for i in range(40)]
    profile = cProfile.Profile()
    profile.runcall(encoder.encode, texts)
    assert sum(x.callcount for x in profile.getstats()) < 2_000


@pytest.mark.parametrize("size", [1, 7, 30, 1000])
def test_slices_hold_every_text_once(size):
    import pyarrow as pa

    texts = ["", "a" * 50, "bc", "d", "", "efg " * 5, "h"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, b)), "text": texts[a:b]}, pa.schema({"doc_id": pa.int64(), "text": pa.string()})) for a, b in ((0, 3), (3, 3), (3, 6), (6, 7))]
    parts = list(tb.slices(iter(batches), size))
    assert [i for ids, _ in parts for i in ids] == list(range(7)) and [t for _, x in parts for t in x.to_pylist()] == texts
    assert all(len("".join(x.to_pylist())) <= size or len([t for t in x.to_pylist() if t]) == 1 for _, x in parts)


def expected(rows):
    whole = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, tb.op1_token_blocks(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected(rows)


def test_edges(spark):
    long = "word and " * 40_000
    rows = [(5, None, 1), (2, "", 2), (9, long, 3), (9, "same id", 4), (None, "no id", 5), (3, "twice", 6), (3, "twice", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long")
    got = tb.token_table(docs).collect()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, 2, 3, 3, 5, 9, 9]
    assert [r.start for r in by_start[1:]] == list(np.cumsum([r.n_tokens for r in by_start])[:-1])
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (n, c) for _, _, n, c in expected([(a, b) for a, b, _ in rows]))
    assert tb.token_table(docs.limit(0)).count() == 0


def test_memory_of_a_worker():
    """MB that encoding takes at most, beyond the tokenizer: bounded by a slice, however large the batches are."""
    code = f"""
import resource
import pyarrow as pa
from duoscope.llm import token_blocks as tb
texts = [" ".join(f"w{{(i * 31 + j * 7) % 5000}}" for j in range(1000)) for i in range(6000)]
batch = pa.RecordBatch.from_pydict({{"doc_id": list(range(6000)), "text": texts}})
del texts
encoder = tb.PieceEncoder({PATH!r})
encoder.encode(["a few words"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(ids) for _, some in tb.slices(iter([batch])) for ids in encoder.encode(some))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
    assert n > 40_000_000 and mb < 80
