"""Fingerprints of one text's near copies: every link is found, few pairs are formed."""

import random

from strataflow.llm import simhash


def brute(prints, bits=3):
    top = {p: p for p in prints}

    def find(p):
        while top[p] != p:
            top[p] = top[top[p]]
            p = top[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_all_links_of_crowded_keys(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(3):
        middle = rng.getrandbits(64)
        for _ in range(250):
            p = middle
            for bit in rng.sample(range(64), rng.choice([2, 3, 4, 5, 6])):
                p ^= 1 << bit
            prints.add(p - (1 << 64) if p >> 63 else p)
        # one segment alone, the other at random
        prints |= {(middle & 0xFFFFFFFF) | (rng.getrandbits(31) << 32) for _ in range(40)}
    prints = sorted(prints)
    want = brute(prints)
    got = {r["node"]: r["component"] for r in simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert {p: got.get(p, p) for p in prints} == want
    assert len(set(want.values())) > 20
