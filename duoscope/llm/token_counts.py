"""Token counts by a unigram model, scored once per shared prefix of the pre-tokens.

Pre-tokens are the words of a text with the word-start mark. Distinct ones are inserted in a trie; each trie node holds the
best forward score over all segmentations of its prefix into vocabulary pieces and how many tokens that takes, so a prefix
that many words share is scored once. The count of a word's end node is its token count. Piece scores come from the ranks of
a public vocabulary file: -log(1 + id). Characters no piece covers cost one byte token per UTF-8 byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import per_process, query, whole_text
from duoscope.session import table

MARK = "▁"
#: Trie nodes and remembered words of a worker process before it starts anew.
MAX_NODES = 600_000
MAX_WORDS = 400_000


class UnigramTrie:
    """Forward scores of word prefixes under piece scores; ``byte_score`` is the score of one fallback byte."""

    def __init__(self, scores: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        self.byte_score, self.max_nodes, self.max_words = byte_score, max_nodes, max_words
        # pieces by their letters from last to first, so that the pieces ending at a place are one walk
        self.ends: dict = {}
        for piece, score in scores.items():
            at = self.ends
            for letter in reversed(piece):
                at = at.setdefault(letter, {})
            at[None] = score
        self.counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def insert(self, pre_token: str) -> int:
        """Token count of the best segmentation: highest score, then fewest tokens."""
        if len(self.best) > self.max_nodes:
            self._clear()
        child, best, tokens, ends = self.child, self.best, self.tokens, self.ends
        node, path = 0, [0]
        for i, letter in enumerate(pre_token):
            below = child.get((node, letter))
            if below is None:
                n_bytes = len(letter.encode())
                high, few = best[node] + n_bytes * self.byte_score, tokens[node] + n_bytes
                at = ends
                for k in range(i, -1, -1):
                    at = at.get(pre_token[k])
                    if at is None:
                        break
                    score = at.get(None)
                    if score is not None:
                        start = path[k]
                        got, n = best[start] + score, tokens[start] + 1
                        if got > high or got == high and n < few:
                            high, few = got, n
                below = child[node, letter] = len(best)
                best.append(high)
                tokens.append(few)
            node = below
            path.append(node)
        return tokens[node]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words, counts = text.split(), self.counts
        try:
            return len(words), sum([counts[w] for w in words])
        except KeyError:
            if len(counts) > self.max_words:
                counts.clear()
            for w in sorted({w for w in words if w not in counts}):
                counts[w] = self.insert(MARK + w)
            return len(words), sum([counts[w] for w in words])


def load_scores(model_path: str) -> tuple[dict[str, float], float]:
    """Piece scores and the byte score of a sentencepiece file; control, unknown and byte pieces are no pieces of words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): -math.log(1 + i) for i in ids}, -math.log(1 + sp.get_piece_size())


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pre_tokens, n_tokens. Null and blank texts have 0 of both; no documents, no rows.

    No shuffle: every worker process scores the distinct words it meets and forgets them when its bounds are reached.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = per_process("counts", model_path, lambda: UnigramTrie(*load_scores(model_path)))
        for batch in batches:
            found = [trie.count(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                ["doc_id", "n_pre_tokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
