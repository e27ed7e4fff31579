"""Lines that are asked for are read again without shuffling the text of all others."""

from pyspark.sql import functions as F

from strataflow.llm import lines


def test_bits_keep_every_asked_row_and_few_others(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id")
    asked = rows.where("id % 20 = 0").select("k")
    kept = lines._likely(rows, asked, 1000, "k")
    assert kept.columns == ["k", "id"]
    got = {r.id for r in kept.collect()}
    assert {i for i in range(20_000) if i % 20 == 0} <= got and len(got) < 6000


def test_lines_are_the_same_by_either_way(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[(i // 2 * 7 + j) % 60] for j in range(12)) + (" extra" if i % 2 else "") + f"\nonly{i} here" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, lines.deduplicated(docs).collect()))
    seen, real = [], lines._likely
    monkeypatch.setattr(lines, "_likely", lambda *a: seen.append(a[2]) or real(*a))
    monkeypatch.setattr(lines, "BROADCAST", 0)
    assert sorted(map(tuple, lines.deduplicated(docs).collect())) == want
    assert seen and sum(r[-1] for r in want) >= 25
