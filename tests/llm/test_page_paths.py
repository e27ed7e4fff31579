"""Page extraction: what belongs to an article stays, names must say it whole, broken markup costs linear work, ratios equal a plain version."""

import math
import random
import re
import time

import pytest

from strataflow.llm import pages

LONG = "This is a long paragraph, with marks of punctuation; it goes on and on. " * 6


def lines(page):
    return pages.main_text(page).split("\n")


def test_short_parts_of_an_article_stay():
    items = "".join(f"<li>item {i}</li>" for i in range(8))
    page = f"<nav><a href=/>Home</a></nav><article><h1><a href=/a>Title</a></h1><p>{LONG}</p><h2>Head</h2><ul>{items}</ul><div><p>End.</p></div></article><div class='site-footer'>Imprint</div>"
    assert lines(page) == ["Title", LONG.strip(), "Head", *[f"item {i}" for i in range(8)], "End."]


def test_quotes_and_last_lines_without_an_article():
    page = "<body>" + f"<p>{LONG}</p>" * 6 + "<blockquote>Said so.</blockquote><p class=sig>A. Writer</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></body>"
    assert lines(page) == [LONG.strip()] * 6 + ["Said so.", "A. Writer"]


@pytest.mark.parametrize("name, stays", [
    ("share-price", True), ("related-work", True), ("commentary", True), ("share-buttons", False), ("relatedPosts", False), ("ad-slot-1", False),
    ("comment-list", False), ("cookie_notice", False), ("sidebar left", False),
])
def test_names_count_where_they_say_it_whole(name, stays):
    assert ("Up again." in lines(f"<article><p>{LONG}</p><div class='{name}'>Up again.</div></article>")) == stays


def test_markup_is_read_as_browsers_do():
    assert lines(f"<article><p title=it's>{LONG}</p><p>don't</p><!--> shown <!-- hidden --></article>") == [LONG.strip(), "don't", "shown"]
    assert lines("<p>a &#65;&#0000066;&#99999999999999999999; < b</p>") == ["a AB� < b"]
    assert lines(f"<p>{LONG}<p>x <b>y<div>z</b>.</div>")[1] == "x y"


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "</p>", "<u><div><i>", "</", "<!--", '<p class="', "<li>x", "&#999999999"])
def test_broken_markup_costs_linear_work(piece):
    def seconds(size):
        start = time.process_time()
        pages.main_text(piece * (size // len(piece)) + "'")
        return time.process_time() - start

    assert seconds(400_000) < 20 * max(seconds(40_000), 0.02)


def plain(page):
    """Paths of p in divs, by loops: ratios, smoothing, fusion, threshold, and the parts that content stands in."""
    blocks = [(m[1], m[2]) for div in re.findall(r"<div class=\"\w+\">.*?</div>", page) for m in re.finditer(r"()<p>(.*?)</p>", div)]
    names = [m[1] for m in re.finditer(r"<div class=\"(\w+)\">(.*?)</div>", page) for _ in re.findall("<p>", m[2])]
    texts = [t for _, t in blocks]
    ratio = {}
    for n in set(names):
        own = [t for k, t in zip(names, texts) if k == n]
        ratio[n] = (sum(map(len, own)) / len(own), (1 + sum(len(re.findall("[.,;:!?]", t)) for t in own)) / len(own))

    def fused(at):
        smooth = []
        for k in (0, 1):
            if len(texts) > 4:
                near = [(math.exp(-((i - at) ** 2) / 2), ratio[names[i]][k]) for i in range(max(0, at - 2), min(len(texts), at + 3))]
                smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            else:
                smooth.append(sum(ratio[n][k] for n in names) / len(names))
        return math.sqrt(max(ratio[names[at]][0], smooth[0]) * max(ratio[names[at]][1], smooth[1]))

    scores = [fused(i) for i in range(len(texts))]
    mean = sum(scores) / len(scores)
    floor = 0.15 * math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    good = {n for n in names if sum(s for s, k in zip(scores, names) if k == n) / names.count(n) >= floor}
    return [t for t, n in zip(texts, names) if n in good]


def test_ratios_equal_a_plain_version():
    rng, dropped = random.Random(3), 0
    for _ in range(200):
        page = "<body>"
        for _ in range(rng.randint(1, 12)):
            name = rng.choice(["one", "two", "three", "four"])
            page += f'<div class="{name}">' + "".join("<p>" + " ".join(["word,"] * rng.choice([1, 1, 2, 60, 400])).rstrip(",") + "</p>" for _ in range(rng.randint(1, 4))) + "</div>"
        wanted = plain(page)
        dropped += len(wanted) < page.count("<p>")
        assert lines(page) == wanted
    assert dropped
