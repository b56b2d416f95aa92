"""Greedy longest-match word-piece lengths by a linear automaton.

The vocabulary is a trie with failure links: a node's link leads to where matching goes on once the longest pieces that
its string surely begins with are popped, and the number of those pieces is precomputed. A word is read byte by byte and
only counts are added; no piece is built. A piece that begins with a blank starts a word, as each word is read with one
blank before it; any other piece continues one. All single bytes must be pieces, so every word can be matched.

Nulls: a null text counts as empty (no words, no tokens). Repeated rows are counted each; other columns are left out. A
text of any length is counted word by word. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Word lengths kept in a worker.
CACHE_WORDS = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """The automaton; nodes are numbers, 0 the root, goto has the child by node * 256 + byte."""

    def __init__(self, pieces: list[bytes]) -> None:
        missing = {bytes([i]) for i in range(256)}.difference(pieces)
        if missing:
            raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
        goto: dict[int, int] = {}
        order: list[list[tuple[int, int, int]]] = []
        n, ends = 1, set()
        for p in pieces:
            u = 0
            for depth, c in enumerate(p):
                v = goto.get(u << 8 | c)
                if v is None:
                    v = goto[u << 8 | c] = n
                    n += 1
                    while len(order) <= depth:
                        order.append([])
                    order[depth].append((v, u, c))
                u = v
            ends.add(u)
        link, popped = [-1] * n, [0] * n
        for level in order:
            for v, u, c in level:
                if v in ends:
                    link[v], popped[v] = 0, 1
                    continue
                z, k = link[u], popped[u]
                while z >= 0 and (z << 8 | c) not in goto:
                    k += popped[z]
                    z = link[z]
                link[v], popped[v] = goto[z << 8 | c], k
        self.goto, self.link, self.popped = goto, link, popped

    def count(self, word: bytes) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        u = k = 0
        for c in word:
            v = goto.get(u << 8 | c)
            while v is None:
                k += popped[u]
                u = link[u]
                v = goto.get(u << 8 | c)
            u = v
        while u:
            k += popped[u]
            u = link[u]
        return k


class WordCounts(dict):
    """Token counts of words, computed when first asked for."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(b" " + word)
        return n


_known: dict[str, WordCounts] = {}


def word_counts(vocabulary_path: str) -> WordCounts:
    """The one of this worker process, with the automaton built and the words it knows already."""
    if vocabulary_path not in _known:
        _known[vocabulary_path] = WordCounts(LongestMatch(read_ranks(vocabulary_path)))
    return _known[vocabulary_path]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens for every document; words are runs of bytes other than ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary_path)
        for b in batches:
            texts = b.column(1).fill_null("").cast(pa.binary())
            words, tokens, size = [], [], []
            for t in texts:
                t = t.as_py()
                w = t.split()
                size.append(len(t))
                words.append(len(w))
                tokens.append(sum(map(counts.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, words, tokens))], ("doc_id", "n_bytes", "n_words", "n_tokens"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")
