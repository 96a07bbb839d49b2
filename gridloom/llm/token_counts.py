"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens.

A text's pre-tokens are its runs of non-blanks, each behind the model's word mark. The count of a pre-token is the
number of pieces in its best segmentation: highest sum of scores, then fewest pieces. Each task puts the pre-tokens it
meets into a trie; a node holds the best score and count of the string from the root to it, computed from its
ancestors once, so pre-tokens with a common prefix share that work, and a terminal node's count is its pre-token's.
Counts need no shuffle: distinct pre-tokens are few beside the text, and a full trie is begun anew.

A piece's score is its log probability under Zipf's law over the vocabulary's order: -log((rank + 1) * H). A character
that no piece begins with counts as its bytes, each at a score below all pieces.

Defined cases: null and empty texts count 0. Pre-tokens of any length are allowed; those over TRIE_LENGTH
characters are counted outside the trie, by the same recurrence. Repeated rows count each. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import tune

WORD_MARK = "▁"
#: Nodes of a task's trie before it is begun anew.
TRIE_NODES = 1_000_000
#: Longer pre-tokens stay out of the trie: their scores roll through a window of the longest piece's length.
TRIE_LENGTH = 1_000
#: Scores are kept as whole multiples of this, so that sums are exact and ties are ties.
_GRAIN = 1 << 20

_COUNT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


@cache
def unigram_scores(path: str) -> tuple[dict[str, int], int, int]:
    """(piece: score, longest piece, score of a byte) from a sentencepiece vocabulary; control and byte pieces aside."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = sum(1 / (i + 1) for i in range(len(model)))
    scores = {model.id_to_piece(i): round(-math.log((i + 1) * total) * _GRAIN) for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return scores, max(map(len, scores)), min(scores.values()) - 10 * _GRAIN


class ScoreTrie:
    """Nodes are numbers; kids maps a character to a node, and best and size hold the forward score and its piece count."""

    def __init__(self, scores: dict[str, int], longest: int, byte_score: int) -> None:
        self.scores, self.longest, self.byte_score = scores, longest, byte_score
        self.clear()

    def clear(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.best, self.size = [0], [0]
        self.counts: dict[str, int] = {}

    def count(self, token: str) -> int:
        """Insert a pre-token; the terminal count is kept by its name as well."""
        found = self.counts.get(token)
        if found is None:
            if len(token) > TRIE_LENGTH:
                return self.roll(token)
            if len(self.kids) > TRIE_NODES:
                self.clear()
            node, path = 0, [0]
            for i, char in enumerate(token):
                nxt = self.kids[node].get(char)
                if nxt is None:
                    nxt = self._grow(node, char, token, i, path)
                node = nxt
                path.append(node)
            found = self.counts[token] = self.size[node]
        return found

    def roll(self, token: str) -> int:
        """The count of a pre-token by the trie's recurrence, with no more than the last `longest` states held."""
        longest, get = self.longest, self.scores.get
        best, size = [0] * (longest + 1), [0] * (longest + 1)  # the state behind i characters is at i modulo longest + 1
        for i in range(len(token)):
            at = i % (longest + 1)
            bytes_ = len(token[i].encode("utf-8", "surrogatepass"))
            score, count = best[at] + bytes_ * self.byte_score, size[at] + bytes_
            for low in range(max(0, i + 1 - longest), i + 1):
                piece = get(token[low : i + 1])
                if piece is not None:
                    at = low % (longest + 1)
                    s, n = best[at] + piece, size[at] + 1
                    if s > score or (s == score and n < count):
                        score, count = s, n
            at = (i + 1) % (longest + 1)
            best[at], size[at] = score, count
        return size[len(token) % (longest + 1)]

    def _grow(self, node: int, char: str, token: str, i: int, path: list[int]) -> int:
        bytes_ = len(char.encode("utf-8", "surrogatepass"))
        score, size = self.best[node] + bytes_ * self.byte_score, self.size[node] + bytes_
        for low in range(max(0, i + 1 - self.longest), i + 1):
            piece = self.scores.get(token[low : i + 1])
            if piece is not None:
                at = path[low]
                s, n = self.best[at] + piece, self.size[at] + 1
                if s > score or (s == score and n < size):
                    score, size = s, n
        self.kids.append({})
        self.best.append(score)
        self.size.append(size)
        self.kids[node][char] = len(self.kids) - 1
        return len(self.kids) - 1


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ScoreTrie(*unigram_scores(path))
        for batch in batches:
            tokens, total = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                known = trie.counts
                n = 0
                for word in words:
                    c = known.get(word)
                    if c is None:
                        c = trie.count(WORD_MARK + word)
                        known = trie.counts
                        if len(word) < TRIE_LENGTH:
                            known[word] = c
                    n += c
                tokens.append(len(words))
                total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(total, pa.int64())], schema=_COUNT)

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_pretokens, n_tokens. vocabulary: a sentencepiece model file, whose order ranks its pieces."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count(vocabulary), "doc_id long, n_pretokens long, n_tokens long")
