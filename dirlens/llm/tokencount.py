"""Token counts under a unigram model, by dynamic programming over a trie.

A text is cut by the tokenizer's pattern; a word's tokens are its segmentation of the greatest summed score, the one of
fewer tokens if two are equal. The forward score of a prefix, the best score of all ways to cut it, depends on the prefix only.
So the distinct words of a block of texts form a trie, each of its nodes is scored once, and terminal nodes keep
their counts. Sorted words are that trie in depth-first order: the path to the last word is a stack of scored nodes, and
the next word adds the nodes below the prefix it shares.

Counting needs no shuffle: a task scores the words it meets and remembers up to ``REMEMBERED`` of them.

Published vocabularies give ranks, not probabilities; ``zipf_scores`` takes the logarithm of a probability in inverse
proportion to the rank.

Defined results: a null or empty text has no tokens; a null id stays null; repeated rows are counted each; other columns
are not looked at; a byte outside the vocabulary is a token of its own with a score below all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from dirlens.llm import pretokens
from dirlens.llm.common import texts

REMEMBERED = 400_000
_BLOCK_ROWS = 1000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    return {token: -log(rank + 2) for token, rank in ranks.items()}


class Trie:
    """Scores words in sorted order; ``scored`` counts the nodes that had to be scored."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.path = b""
        self.forward = [0.0]
        self.tokens = [0]
        self.scored = 0

    def count(self, word: bytes) -> int:
        """The number of tokens of a word."""
        shared = 0
        for a, b in zip(self.path, word):
            if a != b:
                break
            shared += 1
        del self.forward[shared + 1 :], self.tokens[shared + 1 :]
        self.path = word
        forward, tokens, find = self.forward, self.tokens, self.scores.get
        for end in range(shared + 1, len(word) + 1):
            best, fewest = forward[end - 1] + self.unknown, tokens[end - 1] + 1
            for start in range(max(0, end - self.longest), end):
                score = find(word[start:end])
                if score is not None:
                    score += forward[start]
                    if score > best or (score == best and tokens[start] + 1 < fewest):
                        best, fewest = score, tokens[start] + 1
            forward.append(best)
            tokens.append(fewest)
        self.scored += len(word) - shared
        return tokens[-1]

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """The terminal counts of distinct words."""
        return {word.decode(): self.count(word) for word in sorted(w.encode() for w in words)}


def token_counts(docs: DataFrame, scores: dict[bytes, float], pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    # a vocabulary is of fixed size; it goes out once, not with every task
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(sent.value), {}
        for batch in batches:
            for first in range(0, batch.num_rows, _BLOCK_ROWS):
                block = batch.slice(first, _BLOCK_ROWS)
                split = list(pretokens.words(block, pattern))
                if len(known) > REMEMBERED:
                    known.clear()
                known.update(trie.counts({w for words in split for w in words} - known.keys()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": block.column("doc_id"), "n_words": list(map(len, split)),
                    "n_tokens": [sum(map(known.__getitem__, words)) for words in split],
                })

    return pretokens.cut(texts(docs, id_col, text_col), pattern).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
