"""Numbers of greedy word pieces, counted without building the pieces.

The vocabulary is a trie over bytes. Every node knows how many pieces greedy longest match has popped
when no child fits, and the node where it goes on with the bytes read since: the failure link. A word is
one walk along its bytes; each byte moves down once, and links only give back depth, so the time is
linear in the word, whatever the pieces.

The vocabulary must hold every single byte, so any text can be cut. Nulls and empty texts have 0 words
and 0 pieces. Repeated rows get equal results, an empty table an empty one; a text of any length is read whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.bpe import CACHED_WORDS, byte_letters
from hearthpanel.llm.common import pick

# A word with the space before it, contractions, numbers, other signs, white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Automaton of a set of byte pieces. Nodes are numbered breadth first, the root is 0."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    whole.append(False)
                node = self.child[node][byte]
            whole[node] = node > 0
        if missing := [b for b in range(256) if not whole[self.child[0].get(b, 0)]]:
            raise ValueError(f"{len(missing)} single bytes are no pieces, first {missing[0]}")
        self.popped = [0] * len(whole)
        self.link = [0] * len(whole)
        level = [(0, 0, b, v) for b, v in self.child[0].items()]
        while level:
            deeper = []
            for parent, depth, byte, node in level:
                if whole[node]:
                    self.popped[node], self.link[node] = 1, 0
                else:
                    at, count = self.link[parent], self.popped[parent]
                    while byte not in self.child[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    self.popped[node], self.link[node] = count, self.child[at][byte]
                deeper += [(node, depth + 1, b, v) for b, v in self.child[node].items()]
            level = deeper

    def count(self, word: bytes) -> int:
        child, popped, link = self.child, self.popped, self.link
        node = pieces = 0
        for byte in word:
            while byte not in child[node]:
                pieces += popped[node]
                node = link[node]
            node = child[node][byte]
        while node:
            pieces += popped[node]
            node = link[node]
        return pieces


class TextCounter:
    """Counts per text, with a table of bounded size for words met before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        pieces = [bytes(value[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
        self.counter = PieceCounter(pieces)
        self.words = regex.compile(WORDS)
        self.known: dict[str, int] = {}

    def _learn(self, word: str) -> int:
        n = self.counter.count(word.encode())
        if len(word) <= 64:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = n
        return n

    def __call__(self, text: str | None) -> tuple[int, int]:
        words = self.words.findall(text) if text else []
        known = self.known.get
        return len(words), sum([known(w) or self._learn(w) for w in words])


@lru_cache(maxsize=2)
def text_counter(path: str) -> TextCounter:
    return TextCounter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_pieces of every document with the byte vocabulary of ``path``."""

    @F.arrow_udf("struct<n_words:bigint,n_pieces:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        counts = [text_counter(path)(t) for t in texts.to_pylist()]
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_pieces"])

    counted: Column = run(F.col("text"))
    return pick(docs, "doc_id", "text").select("doc_id", counted.alias("n")).select("doc_id", "n.n_words", "n.n_pieces")
