"""Prefix trie, centroid clustering and quality scores against brute force and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import centroids, prefixes, quality

# --- prefix trie ------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, depth string, n1 int, `a.b` int"


def brute_trie(rows):
    per = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + f"{len(text):08x}"
            per[c].append((turn is not None, turn or 0, mark, role, text))
    paths = {c: [x[3:] for x in sorted(v)] for c, v in per.items()}
    full = {}
    for c in paths:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        full[c] = tuple(paths.get(base, [])[:h] + paths[c][h:])
    nodes = defaultdict(list)
    for c, p in full.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        childless = [q for q in below if not any(x[:-1] == q for x in below if x)]
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(1 for q in nodes if q and q[:-1] == path and len(q) == len(path) + 1),
                    len(childless), sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 30), *range(95, 120), 205, 206, -3, -105, 10**12 + 7]:
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.integers(0, 3)} é漢👍"[: int(rng.integers(0, 12))]) for t in range(int(rng.integers(1, 9)))]
    long = [(t, "user", f"turn {t % 5}") for t in range(70)]
    rows += [(300, *x) for x in long] + [(c, *x) for c in (301, 302, 407) for x in long] + [(303, *x) for x in long[:40]] + [(304, *x) for x in long[:41]]  # copies and prefixes
    rows += [(500, None, "system", "first"), (500, None, None, None), (500, 1, "user", "x"), (500, 1, "user", "x"), (500, 1, "user", "x"), (501, 7, None, "y" * 100_000)]
    rows += [(None, 1, "user", "lost"), (600, 2, "b", "two"), (600, 2, "a", "two"), (600, 2, "a", ""), (701, 0, "u", "t"), (702, 0, "u", "t")]
    return rows


@pytest.mark.parametrize("run", [1024, 2])
def test_trie_matches_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(prefixes, "RUN", run)
    monkeypatch.setattr(prefixes, "RANGE", 8)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], CONVERSATIONS).repartition(7)
    got = sorted((tuple(r) for r in prefixes.prefix_trie(df).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    out = prefixes.prefix_trie(empty)
    assert out.count() == 0 and set(dict(out.drop("ends_sha256").dtypes).values()) == {"bigint"}


def test_trie_plan_uses_rollup(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, b"a" * 20, None, None, None)], "conv_id bigint, block bigint, k1 bigint, k2 bigint, chars bigint, t1 binary, t2 binary, t3 binary, t4 binary")
    plan = prefixes.rolled(rows, "count(*) AS n_convs")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


# --- centroid clustering ----------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, cluster string, distance int, `a.b` int"


def brute_clusters(rows, k=centroids.K, rounds=centroids.ROUNDS):
    kept = []
    for vid, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            q = [int(np.floor(256 * v)) for v in x]
            if max(map(abs, q)) < 1 << 27:
                kept.append((vid, q))
    packed = lambda q: np.array(q, "<i4").tobytes()
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))[:k]
    cents = [list(q) for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        for i, g in groups.items():
            cents[i] = [sum(col) // len(g) for col in zip(*g)]
    found = [(vid, *near(q)[::-1]) for vid, q in kept]
    per = defaultdict(int)
    for _, c, d in found:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((v, c, d, per[c], sum(per.values()), digest[c]) for v, c, d in found), key=repr)


def vector_rows(n=150):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(scale=0.2, size=64)).tolist()) for i in range(n)]
    same = rng.normal(size=64).tolist()
    rows += [(1000 + i, same) for i in range(700)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (-4, [0.0] * 64)]
    big = [0.0] * 64
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + big[1:]), (2005, [float("nan")] + big[1:]), (2006, [float("-inf")] + big[1:]), (2007, [1e300] + big[1:])]
    return rows + odd + [(2008, [300_000.0] + big[1:]), (2009, [-0.001] + big[1:])]


def test_clusters_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS).repartition(5)
    got = sorted((tuple(r) for r in centroids.report(*centroids.cluster(df)).collect()), key=repr)
    assert got == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [i / 10] * 64) for i in range(n)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS)
    out = centroids.report(*centroids.cluster(df))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_clusters(rows)
    assert dict(out.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_hilbert_neighbours_differ_by_one_step():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = centroids.hilbert_keys(cells, 3)
    assert len(set(keys)) == 512
    walk = cells[sorted(range(512), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_boxes_rule_centroids_out_but_never_the_nearest():
    rng = np.random.default_rng(1)
    cents = rng.integers(-500, 500, (40, 64))
    for spread in (1, 50, 400):
        x = cents[3] + rng.integers(-spread, spread + 1, (100, 64))
        near = centroids.candidates(x.min(axis=0), x.max(axis=0), cents)
        every = centroids.assign(x, cents, np.arange(40))
        assert all((a == b).all() for a, b in zip(centroids.assign(x, cents, near), every))
        assert spread > 1 or len(near) == 1


def test_distances_are_exact_beyond_doubles():
    x = np.full((1, 64), (1 << 27) - 1, np.int64)
    cents = np.stack([-x[0], -x[0] + 1])
    assert centroids.assign(x, cents, np.arange(2))[1][0] == 64 * (2 * ((1 << 27) - 1) - 1) ** 2


# --- quality classifier -----------------------------------------------------------------------------------

GOOD = "the river runs past the old mill and the people of the town walk along it in the evening light".split()
BAD = "$$$ cheap!!! buy### now&&& click*** here%%% win@@@ free^^^ cash~~~ deal+++".split()


def quality_tables(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(400):
        words = GOOD if i % 3 else BAD
        docs.append((i, " ".join(rng.choice(words, int(rng.integers(20, 200)))), "en", "s", 1, 0.5))
        labels.append((i, int(i % 3 > 0), 0, "x"))
    docs += [(1001, None, None, None, None, 0.1), (1002, "", "en", "s", 0, 0.2), (None, " ".join(GOOD * 3), "en", "s", 1, 0.3), (5, docs[5][1], "en", "s", 1, 0.5), (5, docs[5][1], "en", "s", 1, 0.5),
             (1003, " ".join(GOOD) * 20_000, "en", "s", 1, 0.4), (1004, " ".join(BAD) * 20_000, "en", "s", 1, 0.4)]
    labels += [(1001, 1, 0, "x"), (1002, 0, 0, "x"), (7, 0, 0, "x"), (8, None, 0, "x"), (9, 5, 0, "x"), (None, 1, 0, "x"), (4000, 1, 0, "x")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")


def test_quality_scores(spark):
    docs, labels = quality_tables(spark)
    out = quality.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1003]["predicted"] == 1 and by_id[1004]["predicted"] == 0 and by_id[1001]["score"] == by_id[1002]["score"]
    assert len([r for r in rows if r["doc_id"] == 5]) == 3


def test_quality_equals_plain_compression(spark):
    """The distributed score is the curve over plain, whole-text differences of compressed sizes."""
    import zstandard

    docs, labels = quality_tables(spark)
    model = quality.fit(docs.filter(~quality.held_out()), labels)
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, model, ["doc_id", "text"]).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        size = []
        for content in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=False, write_content_size=False, write_dict_id=False)
            size.append(sum(len(c.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)))
        want = 1 / (1 + np.exp(-(model.slope * (size[0] - size[1]) / max(len(raw), 1) + model.offset)))
        assert got[r["doc_id"], r["text"]] == pytest.approx(want, abs=1e-12)


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels = quality_tables(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda tags: sorted((r["doc_id"] or -1, r["score"]) for r in quality.classify(docs, tags).collect())
    assert score(labels) == score(flipped)


def test_quality_sample_is_bounded(spark):
    docs, labels = quality_tables(spark)
    texts = quality.labelled_sample(docs, labels, 20)
    assert sorted(label for label, _ in texts) == [0] * 20 + [1] * 20 and all(0 < len(t) <= quality.SAMPLE_BYTES for _, t in texts)


def test_quality_without_labels(spark):
    docs, labels = quality_tables(spark)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert min(r["score"] for r in quality.classify(docs, labels.filter("quality = 1 and doc_id > 9 and doc_id < 400")).collect()) > 0.99
    assert quality.classify(docs.limit(0), labels).count() == 0
    few = labels.filter("doc_id in (0, 1, 2, 3)")
    assert quality.classify(docs, few).count() == docs.count()
