"""Line dedup against brute force."""

import random

from pyspark.sql import functions as F

from strataflow.llm import lines


def brute(rows, similarity):
    """rows: (doc_id, text); the texts without lines that an earlier one is as similar to."""
    order = [(d, i, line, frozenset(line.lower().split())) for d, t in sorted(rows) for i, line in enumerate(t.split("\n"))]
    gone = set()
    for k, (d, i, _, own) in enumerate(order):
        if own and any(p and len(own & p) >= similarity * len(own | p) - 1e-9 for _, _, _, p in order[:k]):
            gone.add((d, i))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.choice([1, 3, 9, 10, 20, 40])) for _ in range(60)]
    rows = []
    for d in range(90):
        text = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line).title() if rng.random() < 0.2 else " ".join(line))
        rows.append((d, "\n".join([*text, "", "the same short line"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("ids", F.lit("x"))
    for similarity in (0.9, 0.8):
        out = lines.deduplicated(docs.repartition(5), similarity)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(rows, similarity)
        assert out.columns == [*docs.columns, "n_removed"]


def test_hot_group_of_near_copies_and_edges(spark):
    base = [f"t{i}" for i in range(40)]
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \t \n"), (4, "a b"), (4, "a b"), (5, "x " * 20_000)]
    for k in range(200):
        own = list(base)
        own[k % 40] = f"v{k}"
        rows.append((100 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in lines.deduplicated(docs).collect()]
    assert len(out) == len(rows)
    assert dict(o for o in out if o[0] is not None and o[0] >= 100) == {100 + k: (rows[7][1] if k == 0 else "") for k in range(200)}
    assert sorted((o for o in out if o[0] in (None, 1, 2, 3, 5)), key=str) == sorted([(None, "a b"), (1, None), (2, ""), (3, " \t \n"), (5, "x " * 20_000)], key=str)
    assert [o for o in out if o[0] == 4] == [(4, ""), (4, "")]
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_stores_no_table_of_words_and_rules_pairs_out_before_their_sets_move(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    # lines that share 30 of 40 words are compared with each other, but none is similar to another
    rows = [(d, " ".join(base[:30] + [f"u{rng.randrange(10**6)}" for _ in range(10)])) for d in range(60)] + [(99, " ".join(base))]
    stored = []
    real = lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df: stored.append(real(df)) or stored[-1])
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows, lines.SIMILARITY)
    assert not any("word" in t.columns or "tx" in t.columns for t in stored)


def test_wider_bitmaps_lose_no_pair(spark):
    rng = random.Random(11)
    for parts in (1, lines.WIDTH):
        a = [rng.getrandbits(63) for _ in range(50)]
        b = a[:45] + [rng.getrandbits(63) for _ in range(5)]
        row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        differ = sum((F.bit_count(lines._parity("a", k, parts).bitwiseXOR(lines._parity("b", k, parts))) for k in range(parts)), F.lit(0))
        assert row.select(differ).first()[0] <= 10


def test_long_unlike_lines_of_few_words_are_no_candidates_and_words_meet_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join(rng.sample(words, 150))) for d in range(80)]
    stored = []
    real = lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df: stored.append(real(df)) or stored[-1])
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == dict(rows)
    pairs = [t for t in stored if set(t.columns) == {"a", "b"}]
    # 64 bits differ by chance in as few as 150 words may; the lines' bitmaps are wider
    assert len(pairs) >= 2 * lines.PASSES and sum(t.count() for t in pairs) == 0
