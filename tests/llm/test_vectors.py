"""Search, cover trees and centroids against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import centroids, covertree, search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORDS.findall(lower)


def plain_search(docs, items, top=10):
    split = [(d, plain_terms(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in split if w), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        found = []
        for doc, words in split:
            tf, score = Counter(words), 0
            for t in set(plain_terms(text)) & set(tf):
                m = 100 - 90 + (90 * len(words) * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(found)[:top])]
    return Counter(out)


def test_search_equals_plain_scores(spark):
    rng = np.random.default_rng(5)
    words = ["Ab", "déjà", "the", "of", "x1", "日本"] + [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum())) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w3"), (7, texts[7]), (900, None), (901, ""), (902, " ,;"), (903, "w5 " * 20_000)]
    items = [("a", "w1 W2 w3 w59, the"), ("b", "of the"), ("c", None), ("d", "missing"), (None, "déjà 日本!"), ("a", "w1 W2 w3 w59, the"), ("e", texts[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id string, text string")
    want = plain_search(docs, items)
    for block in (4, 200_000):
        got = search.ranked(frame, asked, block_terms=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == want


def test_search_makes_few_accumulators():
    import pyarrow as pa

    n = 5000
    docs = [(i, ["the", "rare"] if i < 20 else ["the"]) for i in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in docs], pa.int64()), pa.array([len(w) for _, w in docs], pa.int64()),
         pa.array([[t.encode() for t in w] for _, w in docs], pa.list_(pa.binary())), pa.array([[1] * len(w) for _, w in docs], pa.list_(pa.int64()))],
        ["doc_id", "n", "terms", "tfs"],
    )
    here = search._Slice(batch, {b"the": 0, b"rare": 1}, n, n + 20)
    listed, made = here.best([(1, search.weight(n, 20)), (0, search.weight(n, n))], 10, 1)
    assert [d for _, (_, d) in listed] == list(range(10)) and made == 20
    # as a floor from earlier slices closes the list, none is made
    assert here.best([(0, search.weight(n, n))], 10, 10**9) == ([], 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert search.ranked(docs, items).count() == 0
    assert search.ranked(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items.limit(0)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.near_duplicates(none).count() == 0
    assert centroids.clustered(none).count() == 0


def plain_links(rows, cosine=0.93):
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        x = None if v is None or any(e is None for e in v) else np.array(v, dtype=float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            x = x / np.abs(x).max()
            ok[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i in range(len(rows))}
    for i, (la, a) in ok.items():
        for j, (lb, b) in ok.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        top = min(ids) if ids else None
        out.append((vec, len(links[i]), top, vec == top))
    return Counter(out)


def vector_rows(seed, dim=8):
    """Chains and groups at many distances around the threshold, copies, and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows, vec = [], 0
    for label in (1, 2):
        for spread in (0.02, 0.1, 0.2, 0.3):
            middle = rng.normal(size=dim)
            for _ in range(60):
                x = middle / np.linalg.norm(middle) + spread * rng.normal(size=dim)
                rows.append((vec, [float(e) for e in x], label))
                vec += 1
    rows += [(vec + i, rows[5][1], 1) for i in range(40)] + [(vec + 50, [2 * e for e in rows[5][1]], 1), (vec + 51, [1e300 * e for e in rows[5][1]], 1)]
    bad = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0]]
    rows += [(1000 + i, b, 1) for i, b in enumerate(bad)] + [(1100, rows[0][1], None), (None, rows[70][1], 1), (1101, [1.0, 2.1], 1), (1101, [1.0, 2.1], 1)]
    return rows


@pytest.mark.parametrize(("leaf", "sample", "group", "tile"), [(4, 6, 50, 16), (64, 128, 4096, 1024)])
def test_cover_tree_equals_all_pairs(spark, leaf, sample, group, tile):
    rows = vector_rows(3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = covertree.near_duplicates(frame, leaf=leaf, sample=sample, group=group, tile=tile)
    assert Counter(tuple(r) for r in got.collect()) == plain_links(rows)


def test_cover_tree_invariants_and_pruning(spark):
    rng = np.random.default_rng(1)
    points = [(i, [float(e) for e in rng.normal(size=6)], 1) for i in range(300)]
    near = [(300 + i, [float(e) for e in np.array(points[0][1]) + 0.01 * rng.normal(size=6)], 1) for i in range(300)]
    units = covertree.unit_vectors(spark.createDataFrame(points + near, "vec_id long, embedding array<double>, label int"))
    frame = units.selectExpr("gid", "root", "v", "1L AS weight")
    nodes, placed = covertree.grown(frame, math.sqrt(2 - 2 * 0.93), leaf=8, sample=16, group=100)
    assert placed.count() == 600 and placed.select("gid").distinct().count() == 600
    held = {bytes(r["node"]): r for r in nodes.collect()}
    unit = {bytes(r["gid"]): np.frombuffer(r["v"]) for r in placed.collect()}
    for r in placed.collect():
        for node in r["path"]:
            own = held[bytes(node)]
            assert np.linalg.norm(unit[bytes(r["gid"])] - np.frombuffer(own["v"])) <= own["far"] + 1e-6
    for r in held.values():
        assert r["parent"] is None or bytes(r["parent"]) in held
    # a tight group of 300 makes no 45,000 pairs: counts and forests only
    counts, edges = covertree.traversed(nodes, placed)
    assert edges.count() < 3000 and counts.count() < 6000


def plain_kmeans(rows, k=8, rounds=10, seed=3):
    import hashlib

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            part = [v for (_, v), o in zip(kept, own) if o == j]
            if part:
                c[j] = [sum(x) // len(part) for x in zip(*part)]
    last = [nearest(v) for _, v in kept]
    sums = Counter()
    for d, j in last:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    total = sum(sums.values())  # null beyond 64 bits
    return Counter((i, j, d, sums[j], total if total < 1 << 63 else None, sha[j]) for (i, _), (d, j) in zip(kept, last))


@pytest.mark.parametrize("scale", [1.0, 2.0**17])
def test_centroids_equal_plain_rounds(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in scale * (rng.normal(size=64) / 4 + (i % 5 == 0))]) for i in range(150)]
    rows += [(500 + i, rng.integers(-1, 2, 64).astype(float).tolist()) for i in range(20)]
    rows += [(600, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (601, None), (602, [1.0] * 63), (603, [None] * 64), (604, [float("nan")] * 64), (605, [0.0] * 64), (606, [0.0] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = centroids.clustered(frame)
    assert Counter(tuple(r) for r in got.collect()) == plain_kmeans(rows)


def test_few_vectors_and_ties(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert Counter(tuple(r) for r in got.collect()) == plain_kmeans(rows)
    huge = centroids.clustered(spark.createDataFrame([(1, [2.0**53] * 64), (2, [2.0**52] * 64), (3, [-(2.0**52)] * 64)], "vec_id long, embedding array<double>"), count=1)
    assert {(r["vec_id"], r["distance"], r["inertia"]) for r in huge.collect()} == {(2, None, None), (3, None, None)}


def test_orchard_measures_few_distances():
    rng = np.random.default_rng(4)
    c = [[int(x) for x in 1000 * rng.normal(size=2)] for _ in range(200)]
    x = (1000 * rng.normal(size=(500, 2))).astype(np.int64)
    own, d, measured = centroids.Orchard(c).assign(x)
    every = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert measured < 0.5 * every.size
