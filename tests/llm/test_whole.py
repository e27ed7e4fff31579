"""Places where a text operator must do the whole job: every case here was cut short before."""

import random

import numpy as np

from strataflow.llm import language, lines, pages, quality, toxicity, urls


def test_article_weighs_but_does_not_decide():
    body = ["The first paragraph of the story, with all of its details, stands in a plain block; it is long.", "The second one goes on, adds names, places and dates, and ends the story."]
    page = "<html><body><article><h2>Teaser, short.</h2></article>" + "".join(f"<div>{x}</div>" for x in body) + "</body></html>"
    assert pages.main_text(page).split("\n") == ["Teaser, short.", *body]
    long = [f"Paragraph {i} of the article, which is long, has marks, clauses, and words enough to stand out from the rest of the page." for i in range(8)]
    page = "<article>" + "".join(f"<p>{x}</p>" for x in long) + "</article>" + "".join(f"<div><span>{x}</span></div>" for x in "abcdefgh")
    assert pages.main_text(page).split("\n") == long


def test_quality_judges_by_every_language(spark):
    rng = random.Random(1)
    common = {"it": "di che il la per non con sono gli della", "en": "the of and to in is that it for on", "zh": "的 是 了 在"}
    rows = []
    for lang, own in common.items():
        own = own.split()
        for k in range(30):
            words = [rng.choice(own) if rng.random() < 0.4 else "".join(rng.choices("会说写看来去" if lang == "zh" else "aeiorstlm", k=5)) for _ in range(120)]
            rows.append((len(rows), lang, " ".join(words)))
    clean = len(rows)
    rows.append((clean, "it", " ".join("".join(rng.choices("aeiorstlm", k=5)) for _ in range(300))))  # no common word at all
    rows.append((clean + 1, None, rows[70][2]))
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert all(got[i]["kept"] and got[i]["word_distance"] is not None for i in range(clean))
    assert got[clean]["word_distance"] > quality.MAX_WORDS and not got[clean]["kept"]
    assert got[clean + 1]["word_distance"] is None and got[clean + 1]["kept"]


def test_language_learns_all_languages_from_skewed_rows(spark):
    rng = random.Random(5)

    def word(letters):
        return "".join(rng.choices(letters, k=6))

    words = {lang: [word(letters) for _ in range(300)] for lang, letters in {"big": "abcdefgh", "copied": "ijklmnop", "rare": "qrstuvwx"}.items()}
    more = {f"l{k:02}": [word(rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", 6)) for _ in range(60)] for k in range(70)}
    text = lambda own, n: " ".join(rng.choices(own, k=n))
    rows = [("big", text(words["big"], 200)) for _ in range(300)] + [("rare", text(words["rare"], 200)) for _ in range(5)]
    rows += [("copied", text(words["copied"], 200)) for _ in range(100)] + [("copied", text(words["copied"], 50))] * 40_000
    rows += [(lang, text(own, 100)) for lang, own in more.items() for _ in range(2)]
    known = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    held = dict(zip(known.languages, known.contents, strict=True))
    assert set(held) == {*words, *more}
    assert len(held["big"]) == language.DICTIONARY_BYTES == len(held["copied"]) and 4096 < len(held["rare"]) < 10_000
    asked = [(lang, text(own, 60)) for lang, own in (words | more).items()]
    got = language.Judge(known).rows([t for _, t in asked])
    assert [(g[0], g[2]) for g in got] == [(lang, False) for lang, _ in asked]


def test_toxicity_reads_whole_texts():
    for n in range(1, 400):
        starts = toxicity.windows(n)
        assert all(any(s <= at and min(n, at + 24) <= s + toxicity.WINDOW for s in starts) for at in range(max(1, n - 23)))
    assert "".join(toxicity.words_of("字" * 500 + "坏" * 9)) == "字" * 500 + "坏" * 9
    assert toxicity.words_of("short/run " + "/".join(["w1", "w2", "w3"] * 20) + "/vile") == ["short/run", *["w1", "w2", "w3"] * 20, "vile"]
    assert all(len(w.lower().encode()) <= toxicity.LONGEST_WORD for w in toxicity.words_of("😀" * 200 + " " + "İ" * 200 + " " + "x" * 200 + " " + "-" * 200))
    scorer = toxicity.Scorer(toxicity.Network.fresh(np.zeros(toxicity.WORD_ROWS, np.float32), np.random.default_rng(1)))
    for run in ("字" * 100, "a.b." * 50, "x" * 100):
        one, other = scorer.scores([run + "坏坏", run])
        assert one != other


def settled(edges, seeds, rounds=400):
    """Personalised PageRank in plain Python; ``edges`` is a list of (from, to)."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    ranks = {h: 1 / len(seeds) for h in seeds}
    for _ in range(rounds):
        sent = {h: 0.15 / len(seeds) for h in seeds}
        for a, r in ranks.items():
            for b in out.get(a, []):
                sent[b] = sent.get(b, 0.0) + 0.85 * r / len(out[a])
        ranks = sent
    return ranks


def test_ranks_are_settled_and_links_without_scheme_count(spark):
    edges = [("h00.com", "x.net"), *((f"h{i + 1:02}.com", f"h{i:02}.com") for i in range(16)), ("a.org", "b.com"), ("b.com", "c.com"), ("c.com", "b.com"), ("b.com", "h03.com")]
    hosts, linked = sorted({h for e in edges for h in e}), {}
    for k, (a, b) in enumerate(edges):
        linked.setdefault(a, []).append(f'<a href="{"" if k % 2 else "https:"}//{b}/q">x</a>')
    rows = [(k, f"https://{h}/{'fr/' if h == 'a.org' else ''}", "".join(linked.get(h, []))) for k, h in enumerate(hosts)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    trust, distrust = settled(edges, ["a.org"]), settled([(b, a) for a, b in edges], ["x.net"])
    floor = urls.FLOOR / len({*trust, *distrust})
    for r in urls.judged_pages(docs).collect():
        t, d = trust.get(r["host"], 0.0), distrust.get(r["host"], 0.0)
        assert abs(r["trust"] - t) < 0.01 * floor and abs(r["distrust"] - d) < 0.01 * floor
        if r["rule"] is None:
            assert r["verdict"] == ("block" if d >= floor and d > urls.DISTRUST_SHARE * (t + d) else "allow")
        if r["host"] == "h16.com":
            assert r["verdict"] == "block"


def test_lines_with_one_word_of_nine_changed_repeat(spark):
    words = [f"w{i}" for i in range(9)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:8], "other"]) + "\nanother line"), (3, " ".join([*words[:7], "two", "others"]))]
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "another line", 3: rows[2][1]}
