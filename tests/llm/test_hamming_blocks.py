"""The multi-index of decontamination against all pairs of fingerprints."""

from collections import Counter

import numpy as np
import pytest

from barloom.llm import decontam


def items_of(prints):
    own = decontam.Items(5, 5, ids=list(range(len(prints))), counts=[Counter({i: 1}) for i in range(len(prints))], prints=[int(p) for p in prints])
    own.index()
    return own


def with_flips(draw, prints, n):
    """The fingerprints with n bits of each turned over."""
    bits = np.argsort(draw.random((len(prints), 64)), axis=1)[:, :n]
    return prints ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), bits.astype("u8")), axis=1) if n else prints


@pytest.mark.parametrize("radius", [0, 3, 12, 24])
def test_lists_hold_all_within_the_radius(monkeypatch, radius):
    monkeypatch.setattr(decontam, "RADIUS", radius)
    draw = np.random.default_rng(radius)
    prints = draw.integers(0, 1 << 64, 300, dtype="u8")
    own = items_of(prints)
    asked = np.concatenate([with_flips(draw, prints, n) for n in (0, radius // 2, radius, radius + 1)])
    k, i = np.nonzero(np.bitwise_count(asked[:, None] ^ prints) <= radius)
    got = own.near(asked)
    assert set(zip(*got)) == set(zip(k, i)) and len(k) >= 900


def test_allowances_add_up_to_the_radius():
    for radius in range(65):
        some = decontam.allowances(radius)
        assert sum(a + 1 for a in some) == radius + 1 and max(some) - min(some) <= 1
    assert sum(decontam.BLOCKS) == 64


def test_lists_leave_out_a_third_of_random_pairs():
    draw = np.random.default_rng(1)
    own = items_of(draw.integers(0, 1 << 64, 500, dtype="u8"))
    assert own.listed(draw.integers(0, 1 << 64, 500, dtype="u8")).mean() < 0.68
