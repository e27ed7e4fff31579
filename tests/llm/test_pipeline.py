"""The filtering stages of the corpus pipeline on a small fixture, each against plain Python on its own input."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from strataflow.llm import language, simhash

from test_lines import brute as brute_lines

WORDS = {"en": "the of and water stone bridge river morning people under", "de": "der die und wasser stein straße fluss morgen leute unter", "fr": "le la et eau pierre pont fleuve matin gens sous"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    passage = " ".join(f"exam{i}" for i in range(14))
    for d in range(48):
        lang = rng.choice(sorted(WORDS))
        own = lambda n: " ".join(w + rng.choice(["", "s", "er", "xy"]) for w in rng.choices(WORDS[lang].split(), k=n))
        rows.append((d, "\n".join(own(rng.randint(15, 40)) for _ in range(3)), lang))
    rows += [(48, rows[3][1], rows[3][2]), (49, rows[4][1] + "\n" + rows[5][1].split("\n")[0], rows[4][2]), (50, rows[6][1] + "\n" + passage, "en"), (51, rows[7][1].replace("\n", " ") + " " + passage, "de"), (52, None, None), (53, "", "en"), (54, " \n7 8", None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (None, "exam2 exam3"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_language(rows, known):
    kept = []
    for d, t in rows:
        raw = language.plain(t).encode() if t else b""
        if not raw or not known.languages:
            continue
        blocks = [raw[i : i + language.BLOCK_BYTES] for i in range(0, len(raw), language.BLOCK_BYTES)]
        size = lambda content: sum(len(known.encoder(content).compress(b)) for b in blocks)
        sizes = [size(c) for c in known.contents]
        best, even = int(np.argmin(sizes)), list(sizes)
        for k, c in enumerate(known.contents):
            if language.EVENED_BYTES <= len(c) < len(known.contents[best]):
                even[k] = sizes[k] * sizes[best] / size(known.contents[best][: len(c)])
        low, second = sorted(even)[:2]
        if (second - low) / second >= language.MARGIN:
            kept.append((d, t))
    return kept


def plain_simhash(rows):
    prints = {d: simhash.fingerprint(t) & (1 << 64) - 1 for d, t in rows}
    top = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    top[a] = top[b] = min(top[a], top[b])
    return [(d, t) for d, t in rows if top[d] == d]


def plain_leaks(rows, items):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    held = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return [(d, t) for d, t in rows if not held(words(t))]


def test_every_filtering_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    known = language.learn(docs.select("text", "lang"))
    plain = [lambda x: plain_language(x, known), lambda x: sorted(brute_lines(x, 0.8).items()), plain_simhash, lambda x: plain_leaks(x, items)]
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], plain):
        out = stage(spark, docs, folder)
        rows = sorted(by_hand(rows))
        assert out.columns == docs.columns and pairs(out) == rows, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    # every line of 48 repeats: it stays with an empty text, as 49 would beside it
    assert [d for d, _ in rows] == list(range(49)) and not dict(rows)[48].strip()
