"""License scans: fuzzy search for short notices.

A text is lower-cased (A-Z only) and reduced to its words, joined by single blanks. A notice of which up to k bytes may
be inserted, deleted or replaced is split into k + 1 pieces; by the pigeonhole principle one of them must stand in the
text exactly. One automaton finds all these seeds in one pass. A region around a seed must also hold as many four-byte
strings of the notice as k edits leave at least (each edit destroys four at most); the regex library's bounded-error
matching then verifies the notice and reports its span and edits. Beside the fuzzy labels, a few exact phrases are counted at every place.

Defined cases: null text counts as empty; a text without words has no labels, null spans and score 0; repeated rows
and ties give equal rows; very long texts are one row each and are scanned in one pass; an empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hostlens.llm.common import record_batch, slices, utf8

# Phrases that are labelled wherever their words stand consecutively, and wordings of short notices.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("the gnu general public license as published by the free software foundation", "gpl"),
    ("the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
]
ERROR_RATE = 0.1  # edits allowed per byte of a notice
GRAM = 4

WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))),
])


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int
    seeds: tuple[tuple[int, bytes], ...]  # offset in the notice, piece
    grams: tuple[bytes, ...]
    pattern: regex.Pattern

    @classmethod
    def of(cls, text: str, label: str, error_rate: float) -> Notice:
        raw = text.encode()
        k = int(len(raw) * error_rate)
        cuts = [len(raw) * i // (k + 1) for i in range(k + 2)]
        seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:]))
        grams = tuple(raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1))
        return cls(label, raw, k, seeds, grams, regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(raw), k)))

    def find(self, words: bytes, spots: Iterable[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches near the places where a seed says that the notice begins.

        Places that lie closer than the allowed edits share a window, whose best match is one candidate; a window is
        hardly longer than the notice, so the work is linear in the places. Of overlapping candidates the one with the
        fewest edits stays, then the first.
        """
        windows: list[list[int]] = []
        for at in sorted(set(spots)):
            if windows and at - windows[-1][0] <= self.edits:
                windows[-1][1] = at
            else:
                windows.append([at, at])
        found = set()
        for first, last in windows:
            a, b = max(0, first - self.edits), min(len(words), last + len(self.text) + self.edits)
            region = words[a:b]
            if sum(map(region.__contains__, self.grams)) < len(self.grams) - GRAM * self.edits:
                continue
            m = self.pattern.search(words, a, b)
            if m:
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int, int]] = []  # by start, never overlapping
        for edits, start, end in sorted(found):
            i = bisect.bisect(kept, (start, end, edits))
            if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or end <= kept[i][0]):
                kept.insert(i, (start, end, edits))
        return kept


class Scanner:
    """All notices, and one automaton of their seeds (on bytes written as Latin-1 characters)."""

    def __init__(self, notices: Iterable[tuple[str, str]], error_rate: float):
        self.notices = [Notice.of(t, label, error_rate) for t, label in notices]
        places: dict[bytes, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.seeds:
                places.setdefault(piece, []).append((i, offset + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, where in places.items():
            self.seeds.add_word(piece.decode("latin-1"), where)
        if places:
            self.seeds.make_automaton()

    def find(self, words: bytes) -> Iterator[tuple[Notice, int, int, int]]:
        spots: dict[int, list[int]] = {}
        if len(self.seeds):
            for end, where in self.seeds.iter(words.decode("latin-1")):
                for i, back in where:
                    spots.setdefault(i, []).append(end - back)
        for i in sorted(spots):
            for a, b, edits in self.notices[i].find(words, spots[i]):
                yield self.notices[i], a, b, edits


@lru_cache(4)
def scanner(notices: tuple[tuple[str, str], ...], error_rate: float) -> Scanner:
    return Scanner(notices, error_rate)


def normalise(text: bytes) -> bytes:
    """The words of a text, lower-cased and joined by single blanks."""
    return b" ".join(text.lower().translate(WORD_BYTES).split())


def base_places(words: bytes, phrases: list[tuple[str, str]] = PHRASES) -> list[tuple[int, str]]:
    """(byte offset, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        raw = phrase.encode()
        at = words.find(raw)
        while at >= 0:
            end = at + len(raw)
            if (at == 0 or words[at - 1] == 0x20) and (end == len(words) or words[end] == 0x20):
                out.append((at, label))
            at = words.find(raw, at + 1)
    return out


def scan_text(text: bytes, ready: Scanner) -> tuple:
    words = normalise(text)
    n_words = words.count(b" ") + 1 if words else 0
    base, near = base_places(words), list(ready.find(words))
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20) if base or near else ()
    word_at = lambda at: int(np.searchsorted(blanks, at))
    starts = [word_at(at) for at in {min(base)[0], max(base)[0]}] if base else []
    spans, score = [], 1.0 if base else 0.0
    for notice, a, b, edits in near:
        piece = words[a:b]
        lead = len(piece) - len(piece.lstrip())
        spans.append({"label": notice.label, "first_word": word_at(a + lead), "n_words": piece.strip().count(b" ") + 1, "edits": edits})
        score = max(score, 1 - edits / len(notice.text))
    base_labels = {label for _, label in base}
    labels = base_labels | {s["label"] for s in spans}
    return n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document: exact places, labels, the best similarity, and every fuzzy span with its edits."""
    fixed = tuple(tuple(n) for n in notices)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = scanner(fixed, error_rate)
        for batch in slices(batches):
            rows = [scan_text(t, ready) for t in utf8(batch.column("text"))]
            yield record_batch(SCHEMA, [batch.column("doc_id"), *zip(*rows)])

    ddl = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:bigint,n_words:bigint,edits:int>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
