"""The text operators against brute force, round trips and held-out rows; nulls, blanks, repeats, empty and odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strataflow.llm import language, leaks, packing, pages, quality, queries, simhash, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
ODD = [(None, "a b c d"), (1, None), (2, ""), (3, " \t\n"), (4, "One two. Three four, five"), (4, "One two. Three four, five"), (5, "été ÇA ß 日本 语 x" * 3), (6, "long word " * 4000), (7, "a  b\n\n\nc \n d. e\t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "_fp", "w", "key", "start", "_language")})


def test_quality_counts(spark, odd):
    got = {(r["doc_id"], r["n_chars"] if "n_chars" in r else None): r for r in quality.judged(odd).collect()}
    assert len(quality.judged(odd).collect()) == len(ODD) and got
    for r in quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often, covered = collections.Counter(runs), set()
        for i, x in enumerate(runs):
            if often[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in r["text"]), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(odd.limit(0)).count() == 0


def test_distance_is_jensen_shannon(spark):
    p, q = [3, 0, 1], [0.25, 0.5, 0.25]
    got = spark.range(1).select(quality.distance(F.array(*[F.lit(x).cast("long") for x in p]), q, F.lit(4))).first()[0]
    a, b = np.array(p) / 4, np.array(q)
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m) if u > 0)
    assert abs(got - np.sqrt((kl(a) + kl(b)) / 2)) < 1e-9


def test_language(spark, odd):
    out = queries.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    known = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = language.classified(odd, known).select("doc_id", "text", "language.*").collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in rows if not (r["text"] or "").strip())
    assert language.keep_identified(odd, known).columns == odd.columns
    nothing = language.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert language.keep_identified(odd, nothing).count() == 0


def brute_components(rows):
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, f"{prints[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)]


def test_simhash(spark, odd):
    rng = random.Random(3)
    rows, base = list(ODD), [f"w{i}" for i in range(150)]
    for d in range(150):
        own = list(base) if d < 100 else rng.choices(base, k=60)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(base)
        rows.append((100 + d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp", F.lit(0))
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in got}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    import xxhash

    one = xxhash.xxh64_intdigest(b"\xc3\x89t\xc3\xa9 a", 42)
    assert simhash.fingerprint("Été A") & (1 << 64) - 1 == one


def test_urls(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">x</a>' for x in h)
    rows = [
        (1, "http://A.Example.NET/en/1?x", link("good.com")), (2, "https://a.example.net/de/1", None), (3, "http://x.net/", link("good.com")),
        (4, "http://www.example.com/de/2#t", ""), (5, "http://b.org/fr/", ""), (6, "http://bad.com/a", link("x.net", "y.net")), (7, "http://good.com/z", link("b.org")),
        (8, None, None), (9, "no scheme", link("x.net")), (10, "http://notnet/", ""), (10, "http://notnet/", ""), (11, "http://x.net", ""), (12, "ftp://u@H:80?q", ""),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r["page_id"]: r for r in urls.judged_pages(docs).collect()}
    assert urls.judged_pages(docs).count() == len(rows)
    expect = {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.example.net", "/de/1", "net/", "block"), 3: ("x.net", "/", "net/", "block"), 4: ("www.example.com", "/de/2", "example.com/de/", "block"),
              5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("bad.com", "/a", None, "block"), 7: ("good.com", "/z", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
              10: ("notnet", "/", None, "allow"), 11: ("x.net", "", None, got[11]["verdict"]), 12: ("u@h:80", "", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == expect
    assert urls.judged_pages(docs.limit(0)).count() == 0


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choices("ab \n.,'s1é\t", k=14)) for _ in range(1500)] + ["a\xa0b \x85c", "<|endoftext|> x", "ΟΔΟΣ. İx", "don't we'll, it's.", "x́a."]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(public_tokenizers.path(name))
        assert [t for t in texts if e.encode(t) != e.whole(t)] == []


def test_packing(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.packed(odd, path).collect()
    e = tokens.Encoder(path)
    whole = sorted(len(e.encode(t or "")) // 4 + 1 for _, t in ODD)
    assert sum(r["length"] for r in out) == sum(whole) and len([r for r in out if r["piece"] == 0]) == len(ODD)
    ids = np.append(np.frombuffer(e.encode(ODD[7][1]), "<u4"), 2).astype("<u4")
    for r in (r for r in out if r["doc_id"] == 6):
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 1024)
    rows = collections.defaultdict(list)
    for r in out:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in rows.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 1024
    assert packing.packed(odd.limit(0), path).count() == 0
    rng = np.random.default_rng(2)
    histogram = dict(collections.Counter(rng.integers(1, 1025, 3000).tolist()))
    bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
    assert packing.solve(histogram).rows <= 1.02 * bound + 1


def test_token_store(spark, odd):
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], dtype=np.uint32)
    assert tokens.unpack(*tokens.pack(values), len(values)).tolist() == values.tolist()
    path = public_tokenizers.path("word_bpe_49k.json")
    out = sorted((tuple(r) for r in tokens.stored_ids(odd, path).collect()), key=lambda r: r[1])
    e, at = tokens.Encoder(path), 0
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, text), got in zip(ordered, out, strict=True):
        raw = e.whole(text or "") + b"\x02\0\0\0"
        assert got == (d, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert tokens.stored_ids(odd.limit(0), path).count() == 0


def test_leaks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "One TWO three"), (2, " ".join(f"q{i}" for i in range(14))), (None, "a b"), (3, "!!"), (4, None), (10, "five")], "item_id long, text string")
    rows = [*ODD, (20, "x " + " ".join(f"Q{i}" for i in range(2, 13)) + ", y"), (21, "q1 q2 q3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1))
    got = {r["doc_id"]: r for r in leaks.checked(docs, items).collect()}
    assert leaks.checked(docs, items).count() == len(rows)
    digest = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert (got[20]["n_hit"], got[20]["n_items"], got[20]["items_sha256"], got[20]["n_words"]) == (11, 1, digest("2"), 13)
    assert (got[4]["n_hit"], got[4]["items_sha256"], got[4]["contaminated"]) == (4, digest("1", "10"), True)
    assert (got[21]["n_hit"], got[21]["items_sha256"], got[21]["contaminated"]) == (0, digest(), False)
    assert got[1]["n_words"] == 0
    # the item without an id hits words and removes documents, but is not counted
    assert [(got[d]["n_hit"], got[d]["n_items"], got[d]["items_sha256"], got[d]["contaminated"]) for d in (None, 7)] == [(2, 0, digest(), True)] * 2
    assert sorted(str(r["doc_id"]) for r in leaks.keep_clean(docs, items).collect()) == sorted(str(d) for d, _ in rows if d not in (None, 4, 7, 20))
    assert leaks.checked(docs, items.limit(0)).where("contaminated").count() == 0 and leaks.checked(docs.limit(0), items).count() == 0
    few = leaks.hits(docs, items.where("item_id IS NOT NULL"), block=2)
    monkeypatch.setattr(leaks, "LEAST_BITS", 64)
    monkeypatch.setattr(leaks, "MOST_BITS", 64)  # a full table of bits
    assert sorted(map(str, few.collect())) == sorted(map(str, leaks.hits(docs, items.where("item_id IS NOT NULL")).collect()))
    assert sorted(map(str, few.collect())) == sorted(map(str, leaks.hits(docs, items.where("item_id IS NOT NULL")).collect()))


def test_toxicity_learns_and_scores_everything(spark, odd):
    rng = random.Random(4)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "nasty"]
    texts, labels = [], []
    for k in range(900):
        own = rng.choices(common, k=rng.choice([20, 90, 200]))
        if k % 3 == 0:
            own[rng.randrange(len(own))] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append(int(k % 3 == 0))
    net = toxicity.train(texts[:700], labels[:700], epochs=15)
    scores = toxicity.Scorer(net).scores(texts[700:])
    assert np.mean((scores >= 0.5) == np.array(labels[700:], dtype=bool)) > 0.9
    got = toxicity.scored(odd, net).select("text", "score").collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if not (r["text"] or "").strip())
    assert toxicity.scored(odd, toxicity.train(["a"], [1])).where("score <> 0").count() == 0


def test_pages(spark):
    page = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=x>A</a></ul></nav><article><h1>Head &amp; more</h1>
    <p>One  two<br>three, <i>four</i>.<p>Second.<div class="ad">Buy, now.</div></article><div class=comments><p>Nice, text.</p></div><footer>f</footer><script>x='<p>'</script>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<div><p>Plain, text &lt;here. And more words, follow it.</p></div>")]
    out = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out}
    assert len(out) == 5
    assert got[1][0] == "Head & more\nOne two three, four.\nSecond." and got[2] == ("", 0) == got[3]
    assert got[4] == ("Plain, text <here. And more words, follow it.", 45)
