"""Greedy word-piece lengths without building pieces (operator 3).

A trie over the vocabulary carries, at each node, a failure link and the number of tokens that following it pops. One pass
over the characters of a word then yields the number of its longest-match-first pieces in linear time.

Pieces that begin a word carry the vocabulary's word mark, which the matcher puts before every word; a word that the pieces
cannot spell is one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import slices, text_of

MARK = "▁"
_MEMO = 250_000


class LongestMatch:
    """The automaton: ``go`` edges, ``fail`` links (-1: none) and ``pops`` counts by node; node 0 is the root."""

    def __init__(self, pieces: list[str]):
        self.go: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                    whole.append(False)
                node = nxt
            whole[node] = bool(node) or whole[node]
        self.fail, self.pops = [-1] * len(self.go), [0] * len(self.go)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.go[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.fail[node], self.pops[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.pops[parent]
                    while at >= 0 and c not in self.go[at]:
                        at, count = self.fail[at], count + self.pops[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.go[at][c], count
            level = below
        self.memo: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Number of pieces, or 0 if the word cannot be spelt."""
        go, fail, pops = self.go, self.fail, self.pops
        node = total = 0
        for c in word:
            while (nxt := go[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nxt
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return total

    def memoised(self, word: bytes) -> int:
        if len(word) > 64:
            return self.count(MARK + word.decode())
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        n = self.memo[word] = self.count(MARK + word.decode())
        return n


_automata: dict[str, LongestMatch] = {}


def vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a piece-model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    return [p.piece for p in model.pieces if p.type == 1]


def automaton(model_file: str) -> LongestMatch:
    if model_file not in _automata:
        _automata[model_file] = LongestMatch(vocabulary(model_file))
    return _automata[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` of every whole text; words are runs of characters other than ASCII white space.

    An unknown word counts as one token. Null and empty texts have zeros; repeated rows give repeated results, an empty table an empty
    result; columns other than the two named take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model_file)
        memo = a.memo
        for batch in slices(batches):
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                counts = np.array([n if (n := memo.get(w)) is not None else a.memoised(w) for w in words], np.int64)
                unknown = int((counts == 0).sum())
                rows[i] = len(words), int(counts.sum()) + unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
