"""Token counts by greedy longest match in linear time.

The vocabulary is a trie. Where a word cannot go on from a node, the node's failure link leads to
the node reached after the longest pieces on the way have been taken off, and a number stored
with it says how many pieces those were. Every character is read once; no piece is built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .text import as_bytes, with_columns

_KNOWN_WORDS = 300_000


@dataclass
class Automaton:
    """``child``: node * 256 + byte to node; ``fail`` and ``popped`` by node (fail -1: none)."""

    child: dict[int, int]
    fail: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """Pieces of a word (its leading space included); a word that cannot be cut into pieces
        is one unknown token."""
        child, fail, popped = self.child.get, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while (then := child(node << 8 | byte, -1)) < 0:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = then
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def build(vocabulary: list[bytes]) -> Automaton:
    """The automaton of a list of pieces. Breadth first: a node's link needs only shorter ones."""
    child: dict[int, int] = {}
    ends, parent_of = [False], [(0, 0)]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            key = node << 8 | byte
            if key not in child:
                child[key] = len(ends)
                ends.append(False)
                parent_of.append((node, byte))
            node = child[key]
        ends[node] = bool(piece)
    below: list[list[int]] = [[] for _ in ends]
    for node, (parent, _) in enumerate(parent_of[1:], 1):
        below[parent].append(node)
    fail, popped = [-1] * len(ends), [0] * len(ends)
    queue = deque(below[0])
    while queue:
        node = queue.popleft()
        queue.extend(below[node])
        if ends[node]:
            fail[node], popped[node] = 0, 1
            continue
        parent, byte = parent_of[node]
        at, n = fail[parent], popped[parent]
        while at >= 0 and (at << 8 | byte) not in child:
            n += popped[at]
            at = fail[at]
        if at >= 0:
            fail[node], popped[node] = child[at << 8 | byte], n
    return Automaton(child, fail, popped)


def read_vocabulary(lines: Iterable[str]) -> list[bytes]:
    """Pieces of a rank file: base64 of the piece, a space, its rank."""
    return [base64.b64decode(line.split(" ")[0]) for line in lines if line.strip()]


class _Lengths(dict):
    """Pieces of words seen lately; starts anew when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word)
        return n


_lengths: dict[int, _Lengths] = {}


def count_tokens(docs: DataFrame, automaton: Automaton, text: str = "text") -> DataFrame:
    """``docs`` with n_words (between ASCII white space) and n_tokens (pieces of all words, each
    with a space before it). Null, empty and blank texts have 0 of both; columns of ``docs``
    with these names are replaced; repeated rows count alike, other columns stay, and no rows
    give no rows. One pass over whole texts without a shuffle; what is
    broadcast is bounded by the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @arrow_udf("struct<n_words:long, n_tokens:long>")
    def count(column: pa.Array) -> pa.Array:
        automaton = shared.value
        known = _lengths.get(id(automaton))
        if known is None or known.automaton is not automaton:
            _lengths.clear()
            known = _lengths[id(automaton)] = _Lengths(automaton)
        words = [(t or b"").split() for t in as_bytes(column)]
        return pa.StructArray.from_arrays(
            [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())],
            ["n_words", "n_tokens"],
        )

    return with_columns(docs, count(F.col(f"`{text}`")), {"n_words": "n_words", "n_tokens": "n_tokens"})
