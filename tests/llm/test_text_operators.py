"""Tokens, BPE, licenses and language identification against libraries, brute force and held-out labels."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostlens.llm import bpe, language, licenses, tokens
from hostlens.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(bpe.load(PATH)["tokens"])


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


# --- BPE ------------------------------------------------------------------------------------------------


def test_every_token_is_reachable(encoder):
    assert all(encoder._reachable(t) for t in encoder.parts)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAthe <|>'s\n\t1é=", max_size=80))
def test_bpe_equals_the_library(encoder, decoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(encoder, text) == want
    assert "".join(decoder.decode(np.array(want, "<u4"))) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("piece", ["a", "ab", "the", "=", "é", "erstellt", "aab"])
def test_long_words_are_streamed(encoder, library, piece):
    text = piece * 3000
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_stream_and_short_agree(encoder):
    rnd = random.Random(3)
    for _ in range(300):
        word = bytes(rnd.choice(b"abcdeth \xc3\xa9") for _ in range(rnd.randrange(1, 60)))
        assert list(encoder.stream(word)) == encoder.short(word)


def test_stream_keeps_little(encoder):
    """Ids come out long before the word ends."""
    seen = iter(encoder.stream(b"ab" * 20_000))
    assert next(seen) >= 0


def test_utf8_stream_waits_for_whole_characters():
    raw = "aé漢👍z".encode()
    for cut in range(1, 5):
        state = bpe.Utf8Stream()
        got = "".join(state.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + state.feed(b"", last=True)
        assert got == "aé漢👍z"


def test_op3_on_odd_rows(spark, odd_docs, no_docs, library):
    rows = bpe.round_trip(odd_docs, PATH, with_values=True).collect()
    texts = sorted((r["text"] or "") for r in odd_docs.collect())
    assert sorted(r["decoded"] for r in rows) == texts and len(rows) == len(texts)
    for r in rows:
        want = library.encode(r["decoded"], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.round_trip(no_docs, PATH).collect() == []


# --- token counts ---------------------------------------------------------------------------------------


def greedy(word, starts, continues):
    at, n, known = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, n, known = end, n + 1, continues
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12),
       st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12),
       st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8))
def test_automaton_counts_greedy_pieces(starts, continues, words):
    auto = tokens.Automaton(starts, continues)
    for word in words:
        assert auto.count(word) == greedy(word, starts, continues), word


def test_op4_equals_greedy_matching(spark, odd_docs, no_docs):
    starts, continues = map(set, tokens.vocabulary(PATH))
    got = sorted(tuple(r) for r in tokens.count_tokens(odd_docs.filter("doc_id <> 8 or doc_id is null"), PATH).fillna(-1).collect())
    want = []
    for r in odd_docs.filter("doc_id <> 8 or doc_id is null").collect():
        words = [w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-~]", (r["text"] or "").encode())]
        counts = [greedy(w, starts, continues) for w in words]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(words), sum(c or 1 for c in counts), counts.count(0)))
    assert got == sorted(want)
    assert tokens.count_tokens(no_docs, PATH).collect() == []


def test_long_word_is_linear():
    auto = tokens.Automaton([b"a"], [b"a" * 50, b"a"])
    assert auto.count(b"a" * 100_001) == 1 + 2000


# --- licenses -------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


@pytest.fixture(scope="module")
def license_docs(spark, sf, odd_docs):
    more = spark.createDataFrame([
        (101, "MIT  License\nmit-license, (mit LICENSE) mitlicense xmit license mit licensed"),
        (102, "Relased under the MIT licence."), (103, "Licenced under the Apache licence, version 2.0"), (104, "Ünder the General Public License"),
    ], "doc_id bigint, text string")
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(more)


def test_op8_base_places(license_docs):
    texts = license_docs.collect()
    want = []
    for r in texts:
        n, found = base_of(r["text"])
        at = [i for i, _ in found]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], n, len(found), min(at, default=-1), max(at, default=-1), ",".join(sorted({x for _, x in found}))))
    got = licenses.scan(license_docs).fillna(-1, ["doc_id", "first_word", "last_word"])
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == sorted(want)


def test_op8_fuzzy_labels(license_docs):
    got = {r["doc_id"]: r for r in licenses.scan(license_docs.filter("doc_id > 100 and doc_id < 105")).collect()}
    assert got[102]["labels"] == "mit" and got[102]["n_base"] == 0 and 0.8 < got[102]["score"] < 1
    assert got[102]["spans"][0]["first_word"] == 0 and got[102]["spans"][0]["edits"] == 2
    assert got[103]["labels"] == "apache" and got[104]["base_labels"] == "gpl" and got[104]["score"] == 1.0
    assert got[101]["n_base"] == 3


def edits_within(words, notice, k):
    """Smallest edit distance of the notice to any part of the text."""
    row = [0] * (len(words) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_fuzzy_search_misses_nothing():
    rnd = random.Random(5)
    ready = licenses.scanner(tuple(licenses.NOTICES), licenses.ERROR_RATE)
    for _ in range(150):
        notice = rnd.choice(ready.notices)
        text = bytearray(notice.text)
        for _ in range(rnd.randrange(notice.edits + 3)):
            at = rnd.randrange(len(text))
            rnd.choice([lambda: text.insert(at, rnd.choice(b"abc")), lambda: text.pop(at), lambda: text.__setitem__(at, rnd.choice(b"xyz"))])()
        words = licenses.normalise(b"some words " + bytes(text) + b" more words")
        found = any(n is notice for n, *_ in ready.find(words))
        assert found == (edits_within(words, notice.text, notice.edits) <= notice.edits)


def test_repeated_notices_are_all_reported():
    ready = licenses.scanner(tuple(licenses.NOTICES), licenses.ERROR_RATE)
    both = licenses.normalise(b"relesed under the mit license released under the mit license")
    assert [x[1:] for x in ready.find(both)] == [(0, 29, 1), (30, 60, 0)]
    rnd = random.Random(6)
    for _ in range(30):
        notice = rnd.choice(ready.notices)
        texts = []
        for _ in range(rnd.randrange(2, 6)):
            text = bytearray(notice.text)
            for _ in range(rnd.randrange(notice.edits + 1)):
                text[rnd.randrange(len(text))] = ord("q")
            texts.append(bytes(text))
        words = b" ".join(texts)
        found = [(a, b) for n, a, b, _ in ready.find(words) if n is notice]
        assert len(found) == len(texts) and all(abs(a - i * (len(notice.text) + 1)) <= notice.edits for i, (a, _) in enumerate(found))


@pytest.mark.parametrize("phrase", [b"mit license ", b"released under the mit license ", b"the gnu general public "])
def test_scan_is_linear_in_the_text(phrase):
    ready = licenses.scanner(tuple(licenses.NOTICES), licenses.ERROR_RATE)
    times = []
    for n in (5_000, 40_000):
        start = time.process_time()
        out = licenses.scan_text(phrase * n, ready)
        times.append(time.process_time() - start)
        assert out[0] == n * len(phrase.split())
    assert times[1] < 20 * times[0] + 0.5  # eight times the text


def test_op8_odd_rows(odd_docs, no_docs):
    assert licenses.scan(no_docs).collect() == []
    r = {x["doc_id"]: x for x in licenses.scan(odd_docs).collect()}[4]
    assert (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)


# --- language -------------------------------------------------------------------------------------------


def test_op7_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out())
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.97


def test_op7_learns_nothing_from_the_held_out_fold(spark, sf):
    docs = table(spark, sf, "documents").cache()
    spoiled = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(spoiled).collect()))


def test_filter_masks_equal_sets():
    """Without false positives the corrected share is the share of known n-grams."""
    codes, begin = language.grams([b"", b"the cat", b"12 die, katze!", b"", b"x"])
    assert list(np.diff(begin)) == [0, 9 - 3, 11 - 3, 0, 0] and len(codes) == 14
    assert (language.grams([b"die  katze"])[0] == codes[6:]).all()
    model = language.Model(["de", "en"], np.zeros((1 << language.SLOT_BITS, 1), np.uint8), np.zeros(2))
    for i, text in enumerate([b"die katze", b"the cat"]):
        for at in language.places(language.grams([text])[0]):
            model.slots[at] |= np.uint8(1 << i)
    found, number = language.shares(model, [b"the cat", b"die katze", b"zzzzzzz"])
    assert list(number) == [6, 8, 6] and found[0, 1] == 1 and found[1, 0] == 1 and found[2].max() < 0.5


def test_op7_odd_rows(odd_docs, no_docs, spark):
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language.identify(odd_docs).collect()}
    assert {(4, True), (5, True), (6, True), (7, True)} <= got and (1, False) in got
    assert language.identify(odd_docs).count() == odd_docs.count()
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(no_docs).collect() == []
    assert all(0 <= r["score"] <= 1 for r in language.identify(odd_docs).collect())


@pytest.mark.parametrize("size", [7, 64])
def test_long_texts_lose_no_ngram_between_pieces(monkeypatch, size):
    rng = np.random.default_rng(4)
    for _ in range(40):
        text = bytes(rng.choice(np.frombuffer(b"abc  1\xc3\xa9", np.uint8), int(rng.integers(1, 300))))
        monkeypatch.setattr(language, "SLICE", size)
        parts = np.concatenate([*language.long_grams(text), np.zeros(0, np.uint32)])
        assert (parts == language.grams([text])[0]).all()


def sets_of(texts, lang_of):
    """The n-grams of each language by the rules of the docstring, with plain sets."""
    grams = lambda t: set(plain_grams(t))
    langs = sorted(set(lang_of))
    n = {x: lang_of.count(x) for x in langs}
    count = {x: collections.Counter(g for t, y in zip(texts, lang_of) if y == x for g in grams(t)) for x in langs}
    share = {x: {g: c / n[x] for g, c in count[x].items() if c / n[x] >= language.MIN_SHARE} for x in langs}
    top = collections.defaultdict(float)
    for x in langs:
        for g, v in share[x].items():
            top[g] = max(top[g], v)
    return {x: set(sorted((g for g, v in share[x].items() if v >= language.RELATIVE * top[g]), key=lambda g: (-share[x][g], g))[: language.MAX_GRAMS]) for x in langs}


def plain_grams(text):
    clean = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", b" " + text.lower().encode() + b" ")
    return [int.from_bytes(clean[i : i + 4], "little") for i in range(len(clean) - 3)]


def test_op7_equals_plain_sets(spark, sf):
    """The predictions are those of plain sets of n-grams; scores differ by the filters' false positives only."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", "lang", language.held_out().alias("held")).collect()
    seen = {(r["doc_id"], r["text"], r["lang"]) for r in rows if not r["held"] and r["lang"] and r["text"] is not None}
    assert max(collections.Counter(x[2] for x in seen).values()) <= language.SAMPLE_ROWS  # so that the sample is all of them
    known = sets_of([x[1] for x in seen], [x[2] for x in seen])
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, ["doc_id", "text"]).collect()}
    for r in rows:
        found, text = got[r["doc_id"], r["text"]], r["text"]
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (found["lang_pred"], found["score"]) == ("und", 0)
            continue
        mine = plain_grams(text)
        want = {x: sum(g in s for g in mine) / max(len(mine), 1) for x, s in known.items()}
        best = max(want.values())
        assert found["n_grams"] == len(mine) and abs(found["score"] - best) < 0.05
        assert want[found["lang_pred"]] > best - 0.05


def test_op7_many_languages_and_null_ids(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"l{i:03d}": ["".join(rng.choice(letters, 6)) for _ in range(30)] for i in range(100)}
    rows = [(None if i % 2 else i, " ".join(rng.choice(w, 40)), lang) for lang, w in words.items() for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 100 and model.slots.shape[1] == 2
    out = language.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(out) == len(rows) and all(r["lang"] == r["lang_pred"] and r["score"] > 0.5 for r in out)


def test_op7_sample_is_bounded_for_null_and_repeated_rows(spark):
    same = spark.range(5_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(5_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert language.sample(same.unionByName(other), 100).count() == 100 and language.sample(same, 100).count() == 1


def test_short_texts_are_rejected_only_beyond_doubt(spark):
    rows = [("en", 0.0, 10), ("en", 0.0, 300), ("en", 0.0, 400), ("en", 0.09, 10_000), ("en", 0.09, 100_000), ("en", 0.2, 10**6), ("und", 0.0, 0)]
    df = spark.createDataFrame(rows, "lang_pred string, score double, n_grams bigint").withColumn("r", language.rejected())
    assert [r["r"] for r in df.collect()] == [False, False, True, False, True, False, True]
