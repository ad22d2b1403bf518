"""Language identification by the nearest of several centroids per language.

Texts become counts of hashed letter 2-grams and 3-grams, weighted by IDF and normalised. Each language has ``CENTROIDS``
centroids, clustered by cosine from a bounded sample of labelled texts. A text gets the language of the nearest centroid and
is rejected where its distance is beyond what texts of that length in that language show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import packed, per_process, query
from duoscope.session import collect_bounded, scratch_path, table

DIMS = 1 << 13
CENTROIDS = 4
#: Texts per language that the model is fitted on, by the smallest hashes; documented bound of the fit.
SAMPLE = 400
MAX_LANGS = 1_000
#: A text is rejected below this share of the similarity that all but 1% of its language's texts of its length reach.
SLACK = 0.5
CHUNK = 1 << 20
BUCKETS = 24
UNKNOWN = "und"


class Grams:
    """Counts of hashed 2-grams and 3-grams over lower-cased letters; other characters are one blank between words."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(DIMS, np.int64)
        text = f" {text} "  # so that a single letter has n-grams too
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[max(0, at - 2):at + CHUNK].lower().encode("utf-32-le"), np.uint32)
            codes = np.where(self.letter[codes], codes, np.uint32(32))
            blank = codes == 32
            if blank.all():
                continue
            codes = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
            h = codes * np.uint32(2654435761)
            two = (h[:-1] ^ (codes[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
            out += np.bincount(two >> np.uint32(19), minlength=DIMS)
            three = (two[:-1] ^ (codes[2:] * np.uint32(668265263))) * np.uint32(374761393)
            out += np.bincount(three >> np.uint32(19), minlength=DIMS)
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length; square roots keep the direction independent of the length of the text."""
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine; the starts are the mean and then the rows farthest from all before, so reruns agree."""
    starts = [x.mean(axis=0)]
    while len(starts) < min(k, len(x)):
        starts.append(x[np.argmin(np.max(x @ np.array(starts).T, axis=1))])
    centers = np.array(starts)
    for _ in range(rounds):
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ centers.T, axis=1)
        centers = np.array([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
    return (centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _floors(counts: np.ndarray, idf: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per power of two of n-grams, the similarity that all but 1% of the sample reach; texts are thinned to that length."""
    rng = np.random.default_rng(7)
    total = counts.sum(axis=1)
    out = np.full(BUCKETS, np.nan)
    for b in range(BUCKETS):
        sel = total >= 1 << b
        if sel.any():
            thin = rng.binomial(counts[sel], ((1 << b) / total[sel])[:, None])
            thin = thin[thin.sum(axis=1) > 0]
            if len(thin):
                out[b] = np.quantile((weighted(thin, idf) @ centers.T).max(axis=1), 0.01)
    known = np.flatnonzero(~np.isnan(out))
    return np.interp(np.arange(BUCKETS), known, out[known]) if len(known) else np.zeros(BUCKETS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> dict:
    """Learns from text and lang of the rows that are not held out and have a doc_id and a lang.

    The sample of a language are the rows whose hash is below sample/count; languages are grouped, so no task sees more
    than one language's sample.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = collect_bounded(rows.groupBy("lang").count(), MAX_LANGS, "languages")
    model = {"idf": np.ones(DIMS, np.float32), "langs": [], "centers": np.zeros((0, DIMS), np.float32),
             "owner": np.zeros(0, int), "floors": np.zeros((0, BUCKETS))}
    if not counts:
        return model
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = per_process("langid", "grams", Grams)
        for batch in batches:
            found = [grams(t.as_py()).astype(np.int32).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(found, pa.binary())], ["lang", "counts"])

    path = scratch_path(spark, "langid-sample")
    drawn.mapInArrow(features, "lang string, counts binary").write.parquet(path)
    stored = spark.read.parquet(path)

    def matrix(part: pd.DataFrame) -> np.ndarray:
        x = np.stack([np.frombuffer(c, np.int32) for c in part["counts"]])
        return x[x.sum(axis=1) > 0]

    def occurrences(part: pd.DataFrame) -> pd.DataFrame:
        x = matrix(part)
        return pd.DataFrame({"n": [len(x)], "df": [(x > 0).sum(axis=0).astype(np.int64).tobytes()]})

    found = stored.groupBy("lang").applyInPandas(occurrences, "n long, df binary").collect()  # a row per language
    n, df = sum(r["n"] for r in found), sum(np.frombuffer(r["df"], np.int64) for r in found)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def centers(part: pd.DataFrame) -> pd.DataFrame:
        x = matrix(part)
        if not len(x):
            return pd.DataFrame({"lang": [], "centers": [], "floors": []})
        c = cluster(weighted(x, idf), centroids)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "centers": [c.tobytes()], "floors": [_floors(x, idf, c).tobytes()]})

    learned = stored.groupBy("lang").applyInPandas(centers, "lang string, centers binary, floors binary").collect()
    learned.sort(key=lambda r: r["lang"])
    blocks = [np.frombuffer(r["centers"], np.float32).reshape(-1, DIMS) for r in learned]
    model["idf"] = idf
    model["langs"] = [r["lang"] for r in learned]
    if blocks:
        model["centers"] = np.concatenate(blocks)
        model["owner"] = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        model["floors"] = np.array([np.frombuffer(r["floors"], np.float64) for r in learned])
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """row (all columns but text), text and: lang (``und`` for null texts, texts without letters and an empty model), score
    (cosine, 0 to 1), rejected. Only the text is read. The model has ``CENTROIDS`` rows per language and at most MAX_LANGS languages."""
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = packed(docs)
    schema = rows.select("*", F.lit("").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(shipped.value)
        grams = per_process("langid", "grams", Grams)
        names = np.array([*m["langs"], UNKNOWN], dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(batch.schema.get_field_index("text"))
                counts = np.stack([grams(t.as_py() or "") for t in texts])
                total = counts.sum(axis=1)
                best, score = np.full(len(counts), len(m["langs"])), np.zeros(len(counts))
                rejected = np.ones(len(counts), bool)
                some = np.flatnonzero(total > 0)
                if len(some) and len(m["langs"]):
                    near = weighted(counts[some], m["idf"]) @ m["centers"].T
                    top = near.argmax(axis=1)
                    best[some] = m["owner"][top]
                    score[some] = np.clip(near[np.arange(len(some)), top], 0, 1)
                    bucket = np.minimum(np.log2(total[some]).astype(int), BUCKETS - 1)
                    rejected[some] = score[some] < SLACK * m["floors"][best[some], bucket]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)],
                    [*batch.schema.names, "lang", "score", "rejected"])

    return rows.mapInArrow(run, schema)


@query("op2_langid")
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("lang").alias("lang_pred"),
                        "score", "rejected")
