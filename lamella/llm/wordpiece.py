"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A node's failure link leads where matching goes on
after the longest pieces have been cut off the node's text, and the node keeps how many
those are. So a word is read once, byte by byte, and its number of pieces is a
sum: no piece is built, nothing is read twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SLICE_BYTES, buffers, released

GENERATION = 200_000


class Automaton:
    """Pieces that begin a word and pieces that go on with it; a word that they can't make up counts as one unknown piece."""

    def __init__(self, initial: Iterable[bytes], going_on: Iterable[bytes]):
        self.next: dict[int, int] = {}
        ends, size = set(), 2  # node 0: a word's start, node 1: after a piece
        parent: list[tuple[int, int]] = [(0, 0), (1, 0)]
        for root, pieces in ((0, initial), (1, going_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 8 | c
                    if key not in self.next:
                        self.next[key] = size
                        parent.append((node, c))
                        size += 1
                    node = self.next[key]
                if piece:
                    ends.add(node)
        kids: list[list[int]] = [[] for _ in range(size)]
        for node in range(2, size):
            kids[parent[node][0]].append(node)
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque(kids[0] + kids[1])
        while queue:
            node = queue.popleft()
            queue.extend(kids[node])
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
                continue
            up, c = parent[node]
            at, n = self.fail[up], self.popped[up]
            while at >= 0 and at << 8 | c not in self.next:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.next[at << 8 | c], n

    def count(self, word: bytes) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for c in word:
            while True:
                to = step.get(node << 8 | c)
                if to is not None:
                    node = to
                    break
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a leading space begin a word, the others go on with it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        words = [bytes(code[c] for c in w) for w in json.load(f)["model"]["vocab"] if all(c in code for c in w)]
    return [w for w in words if w[:1] == b" "], [w for w in words if w[:1] != b" "]


class Counter:
    """Pieces of white-space words, kept for the words seen lately."""

    def __init__(self, path: str):
        self.automaton = Automaton(*byte_level_pieces(path))
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        for w in words - self.young.keys():
            self.young[w] = self.old.get(w) or self.automaton.count(b" " + w)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row (doc_id, n_words, n_tokens) for each row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; each is a space and the word, and takes
    the longest piece each time. A null or empty text has none. Ids may be null or repeat; columns other than
    doc_id and text are ignored.
    """

    @released
    def run(batches):
        counter = _counters.get(vocabulary_path) or _counters.setdefault(vocabulary_path, Counter(vocabulary_path))
        for batch in batches:
            data, at = buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = i + 1
                while j < batch.num_rows and at[j + 1] - at[i] < SLICE_BYTES:
                    j += 1
                split = [data[at[k] : at[k + 1]].tobytes().split() for k in range(i, j)]
                counter.learn(set().union(*split))
                get = counter.young.__getitem__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in split], pa.int64()), pa.array([sum(map(get, s)) for s in split], pa.int64())], ["doc_id", "n_words", "n_tokens"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
