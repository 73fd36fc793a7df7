"""BPE encoding and decoding as streaming transducers.

Encoding. Two adjacent tokens are compatible if encoding their joined bytes gives the same two tokens back. A sequence
of tokens is the BPE encoding of its bytes exactly if all neighbours are compatible, and the encoding of every prefix
of a word ends in one definite token. The transducer therefore keeps, for each position, the one token that ends there;
a token may start where its left neighbour is compatible with it. Since no token is longer than the longest entry of
the merge list, only that many positions can still be extended: this is the lookahead that the merge list makes
sufficient. Tokens on which all extendable positions agree are stable and emitted, so memory does not depend on the
length of a word. Words are cut by the tokenizer's pattern; special tokens are found before.

Decoding. Token bytes are concatenated chunk by chunk; a state machine for UTF-8 holds back the bytes of a character
that is not complete yet. Bytes that can never become text are replaced as the library does.

Defined cases: null text counts as empty and has no tokens; texts that contain the special token's string get its id;
very long texts and words are streamed; repeated rows give equal rows; an empty table gives an empty result. Columns of
the input that the caller keeps pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hostlens.llm.bytelevel import byte_of_char
from hostlens.llm.common import slices

# Fixed value: the word pattern of the byte-level tokenizer; \s means Unicode white space there. Runs of letters come
# first, since no other branch can match what they match, and runs never give characters back.
PATTERN = r" ?\p{L}++|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}++"
MEMORY_WORDS = 1 << 17  # about 30 MB
SHORT = 64  # bytes of a word that is worth remembering
NEVER = 1 << 60


def load(path: str) -> dict:
    """Token bytes, merges (left id, right id, merged id) in order, and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    chars, vocab = byte_of_char(), raw["model"]["vocab"]
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    tokens = {i: t.encode() for t, i in special.items()}
    tokens |= {i: bytes(chars[c] for c in t) for t, i in vocab.items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "special": special}


class Encoder:
    def __init__(self, vocab: dict):
        self.tokens: dict[int, bytes] = vocab["tokens"]
        self.special: dict[str, int] = vocab["special"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # merged token: its last merge
        self.formed: dict[int, int] = {}  # merged token: the rank of that merge
        for r, (a, b, c) in enumerate(vocab["merges"]):
            self.rank.setdefault((a, b), r)
            if c not in self.parts:
                self.parts[c], self.formed[c] = (a, b), r
        self.lookahead = max((len(self.tokens[c]) for c in self.parts), default=1)
        self.trie: dict = {}
        for i, raw in self.tokens.items():
            if raw and i not in self.special.values() and self._reachable(i):
                node = self.trie
                for c in raw:
                    node = node.setdefault(c, {})
                node[-1] = i
        self.memory: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token on this edge of the merge tree, rank at which it is consumed), from the whole token down to a byte."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.formed[token]
            token = self.parts[token][side]

    def _crossed(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether a merge across the boundary comes before the two tokens are complete, and before rank `until`.

        Of equal merges that overlap, the left one happens first.
        """
        right_edge = self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in right_edge:
                r = self.rank.get((x, y))
                if r is not None and r < min(x_until, until) and r <= y_until:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        if token not in self.parts:
            return len(self.tokens[token]) == 1
        a, b = self.parts[token]
        return not self._crossed(a, b, self.formed[token]) and self._reachable(a) and self._reachable(b)

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 1 << 20:
                self.pairs.clear()
            known = self.pairs[key] = not self._crossed(left, right)
        return known

    def stream(self, data: bytes) -> Iterator[int]:
        """Token ids of one word, each emitted as soon as it is stable."""
        trie, tokens, pairs, compatible = self.trie, self.tokens, self.pairs, self.compatible
        ends: dict[int, int] = {}  # position: the token that ends there, for positions not emitted yet
        size, done, last, check = len(data), 0, -1, 4 * self.lookahead
        for at in range(size):
            left = ends.get(at, last) if at != done else last
            if at != done and at not in ends:
                continue
            node, end = trie, at
            while end < size:
                node = node.get(data[end])
                if node is None:
                    break
                end += 1
                token = node.get(-1)
                if token is not None and end not in ends:
                    if left < 0:
                        ends[end] = token
                    else:
                        ok = pairs.get(left << 20 | token)
                        if compatible(left, token) if ok is None else ok:
                            ends[end] = token
            if at - done >= check:  # every later token starts at one of the positions that are still open
                paths = []
                for p in range(at + 1, min(at + self.lookahead, size) + 1):
                    if p in ends:
                        path = []
                        while p > done:
                            path.append(p)
                            p -= len(tokens[ends[p]])
                        paths.append(path[::-1])
                stable = 0
                while all(len(x) > stable and x[stable] == paths[0][stable] and x[stable] <= at for x in paths):
                    stable += 1
                for p in paths[0][:stable]:
                    last = ends[p]
                    yield last
                    done = p
                for p in [p for p in ends if p <= done]:
                    del ends[p]
                check = 4 * self.lookahead if stable else check * 2
        out, p = [], size
        while p > done:
            out.append(ends[p])
            p -= len(tokens[ends[p]])
        yield from reversed(out)

    def short(self, data: bytes) -> list[int]:
        """Token ids of a word that fits the lookahead as a whole.

        The longest token that is compatible with its left neighbour is tried first; a position from which nothing goes
        on is dead for good, because the token that ends there is the only one.
        """
        trie, pairs, compatible = self.trie, self.pairs, self.compatible
        size, at, out = len(data), 0, []
        options: list[list[tuple[int, int]]] = []
        dead: set[int] = set()
        choices = None
        while at < size:
            if choices is None:
                choices, node, end = [], trie, at
                while end < size:
                    node = node.get(data[end])
                    if node is None:
                        break
                    end += 1
                    token = node.get(-1)
                    if token is not None:
                        choices.append((token, end))
            while choices:
                token, end = choices.pop()
                if end in dead:
                    continue
                if out:
                    ok = pairs.get(out[-1] << 20 | token)
                    if not (compatible(out[-1], token) if ok is None else ok):
                        continue
                out.append(token)
                options.append(choices)
                at, choices = end, None
                break
            else:
                dead.add(at)
                at -= len(self.tokens[out.pop()])
                choices = options.pop()
        return out

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        raw = word.encode()
        ids = self.short(raw) if len(raw) <= SHORT else list(self.stream(raw))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= SHORT:
            if len(self.memory) >= MEMORY_WORDS:
                self.memory.clear()
            self.memory[word] = packed
        return packed

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in chunks."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text, at, m.start())
            yield struct.pack("<I", self.special[m.group()])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        if start >= end:
            return
        part = text if start == 0 and end == len(text) else text[start:end]
        seen, word = self.memory.get, self.word
        if len(part) <= 1 << 20:
            yield b"".join([seen(w) or word(w) for w in self.words.findall(part)])
            return
        for m in self.words.finditer(part):
            w = m.group()
            yield seen(w) or word(w)


class Utf8Stream:
    """Bytes in, text out; an incomplete character waits for its next bytes."""

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        cut = len(data)
        if not last:
            for back in range(1, min(4, cut + 1)):
                byte = data[cut - back]
                if byte < 0x80:
                    break
                if byte >= 0xC0:
                    needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                    if needs > back:
                        cut -= back
                    break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Decoder:
    CHUNK = 1 << 16  # tokens

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens, default=-1) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Text of the ids, in chunks."""
        state = Utf8Stream()
        for i in range(0, len(ids), self.CHUNK):
            part = ids[i : i + self.CHUNK]
            n = self.length[part]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(self.start[part] - (ends - n), n)
            yield state.feed(self.data[at].tobytes())
        if state.rest:
            yield state.feed(b"", last=True)


_ready: dict[str, tuple[Encoder, Decoder]] = {}  # per worker process, by file


def round_trip(docs: DataFrame, path: str, keep: list[str] | None = None, with_values: bool = False) -> DataFrame:
    """`keep` columns (default: doc_id), n_tokens, ids_sha256, decoded_sha256; `with_values` adds ids and decoded."""
    vocab = docs.sparkSession.sparkContext.broadcast(load(path))  # the size of the tokenizer file
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[c for c in keep if c != "text"], "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ready:
            _ready[path] = Encoder(vocab.value), Decoder(vocab.value["tokens"])
        encoder, decoder = _ready[path]
        for batch in slices(batches):
            counts, id_sums, text_sums, values, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = b"".join(encoder.encode(text or ""))
                ids = np.frombuffer(packed, "<u4")
                whole = hashlib.sha256()
                pieces = []
                for piece in decoder.decode(ids):
                    whole.update(piece.encode())
                    if with_values:
                        pieces.append(piece)
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(packed).hexdigest())
                text_sums.append(whole.hexdigest())
                if with_values:
                    values.append(ids.astype(np.int64))
                    texts.append("".join(pieces))
            out = {c: batch.column(c) for c in keep}
            out |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}
            if with_values:
                out |= {"ids": pa.array(values, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        encoder.memory.clear()  # the worker goes on to other tasks

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    more = ["ids array<bigint>", "decoded string"] if with_values else []
    return rows.mapInArrow(run, ", ".join([*kept, "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *more]))
