"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Each node knows its failure node and how many pieces are popped on the way
there, so greedy longest-match-first word pieces are counted in one pass over a word, without building the pieces and
without backing up. Words are runs of letters, digits and non-ASCII characters; other visible ASCII characters are
words of their own.

The pieces come from a public byte-level vocabulary: an entry that begins with the blank mark may start a word, one
without it may continue a word. A word that cannot be covered counts as one unknown piece, as word pieces do.

Defined cases: null or empty text has no words and no pieces; very long words and texts take linear time; repeated rows
give equal rows; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hostlens.llm.bytelevel import byte_of_char
from hostlens.llm.common import record_batch, slices, utf8

MEMORY_WORDS = 1 << 18
WORD = bytes(c if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
MARKS = [c for c in range(0x21, 0x7F) if WORD[c] == 0x20]


class Automaton:
    """Counts greedy word pieces; `starts` may begin a word, `continues` may follow."""

    def __init__(self, starts: Iterable[bytes], continues: Iterable[bytes]):
        self.go: list[dict[int, int]] = [{}, {}]  # node 0: word start, node 1: after a piece
        self.piece = [False, False]
        for root, words in ((0, starts), (1, continues)):
            for word in words:
                node = root
                for c in word:
                    nxt = self.go[node].get(c)
                    if nxt is None:
                        nxt = self.go[node][c] = len(self.go)
                        self.go.append({})
                        self.piece.append(False)
                    node = nxt
                if word:
                    self.piece[node] = True
        self.fail = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.go[u].items():
                if self.piece[v]:  # what was read is a piece: pop it, go on after it
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.go[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.go[z][c], n
                queue.append(v)
        self.memory: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it cannot be covered."""
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in word:
            nxt = go[node].get(c)
            while nxt is None:
                if fail[node] < 0:
                    return 0
                n += pops[node]
                node = fail[node]
                nxt = go[node].get(c)
            node = nxt
        while node != 1:
            if fail[node] < 0:
                return 0
            n += pops[node]
            node = fail[node]
        return n

    def __getitem__(self, word: bytes) -> int:
        """The count with a bounded memory of words seen; an uncovered word is one unknown piece, marked by -1."""
        n = self.memory.get(word)
        if n is None:
            n = self.count(word) or -1
            if len(self.memory) >= MEMORY_WORDS:
                self.memory.clear()
            if len(word) <= 64:
                self.memory[word] = n
        return n


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, pieces that continue one) of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    chars = byte_of_char()
    raw = [bytes(chars[c] for c in entry) for entry in entries if all(c in chars for c in entry)]
    return [x[1:] for x in raw if x[:1] == b" " and len(x) > 1], [x for x in raw if x[:1] != b" "]


_ready: dict[str, Automaton] = {}  # per worker process, by file

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("n_unknown", pa.int64())])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: words, pieces (an unknown word is one), and unknown words."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the size of the vocabulary file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _ready.get(path) or _ready.setdefault(path, Automaton(*pieces.value))
        marks = np.array([auto[bytes([c])] for c in MARKS])
        for batch in slices(batches):
            words, total, unknown = [], [], []
            for text in utf8(batch.column("text")):
                mine = text.translate(WORD).split()
                seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)[MARKS]
                counts = np.fromiter(map(auto.__getitem__, mine), np.int64, len(mine))
                words.append(len(mine) + int(seen.sum()))
                total.append(int(np.abs(counts).sum() + np.abs(marks) @ seen))
                unknown.append(int((counts < 0).sum() + (marks < 0) @ seen))
            yield record_batch(SCHEMA, [batch.column("doc_id"), words, total, unknown])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_pieces bigint, n_unknown bigint")
