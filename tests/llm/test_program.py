"""The packing program: it places the pieces itself, within its bounds, and no worse than best fit by more than a little."""

import collections

import numpy as np
import pytest

from strataflow.llm import packing

RNG = np.random.default_rng(1)


def histogram(values):
    out = collections.Counter()
    for n in values.tolist():
        out[1024] += n // 1024
        out[n % 1024] += 1
    return {k: n for k, n in out.items() if k and n}


def counted(h):
    lengths = np.array(sorted(h))
    wanted = np.array([h[int(k)] for k in lengths])
    used, left = packing.covered(lengths, wanted, 1024)
    placed = left.copy()
    for config, times in used.items():
        assert times > 0 and sum(n * int(lengths[j]) for j, n in config) <= 1024
        for j, n in config:
            placed[j] += n * times
    assert (placed == wanted).all() and (left >= 0).all()
    return sum(used.values()) + len(packing.best_fit(lengths, left, 1024)), 1 - left.sum() / wanted.sum(), len(packing.best_fit(lengths, wanted, 1024)), used


@pytest.mark.parametrize("n", [20_000, 800_000])
def test_the_program_places_the_pieces(n):
    rows, share, alone, _ = counted(histogram(np.exp(RNG.normal(5.5, 1.1, n)).clip(1, 3000).astype(int)))
    assert share >= 0.95 and rows <= 1.001 * alone


def test_fewer_rows_than_best_fit_where_it_errs():
    rows, share, alone, _ = counted(histogram(RNG.integers(300, 400, 50_000)))
    assert share >= 0.95 and rows < 0.97 * alone


def test_uniform_lengths_lose_less_than_a_hundredth():
    rows, _, alone, _ = counted(histogram(RNG.integers(1, 1025, 20_000)))
    assert rows <= 1.01 * alone


@pytest.mark.parametrize("h, rows", [({700: 100_000}, 100_000), ({1: 100_000}, 98), ({700: 100_000, 324: 50_000}, 100_000), ({3: 2, 1000: 1}, 1), ({1024: 5, 5: 1}, 6), ({}, 0)])
def test_plain_histograms(h, rows):
    assert packing.solve(h).rows == rows


def test_work_grows_with_the_logarithm_of_the_counts():
    lengths = np.arange(1, 129)
    wanted = RNG.integers(1, 50, 128)
    steps = [len(packing.covered(lengths, wanted * 10**k, 128)[0]) for k in (3, 6, 9)]
    assert steps[2] - steps[1] < 1.5 * (steps[1] - steps[0])
