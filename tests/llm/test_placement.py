"""Placement on small inputs against all ways of placing."""

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.packing import best_fit
from sparkloom.llm.sharding import difference

CAPACITY = 12


def fewest(lengths):
    """The least number of bins that hold all lengths, by trying every bin for every item."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, CAPACITY - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, CAPACITY - 1), min_size=1, max_size=8))
def test_packing_is_near_the_fewest_bins(lengths):
    bins = best_fit(np.array(lengths), CAPACITY)
    sums = np.bincount(bins, lengths)
    assert sums.max() <= CAPACITY and len(bins) == len(lengths)
    # Never more than one bin above the fewest for so few items; items above half a bin alone are packed best.
    assert len(set(bins.tolist())) <= fewest(sorted(lengths, reverse=True)) + 1
    if min(lengths) > CAPACITY // 3:
        assert len(set(bins.tolist())) == fewest(sorted(lengths, reverse=True))


def spread_of(sizes, parts):
    """The least difference between the largest and the smallest sum of all ways to deal out sizes."""
    return min(int(np.ptp(np.bincount(ways, sizes, parts))) for ways in product(range(parts), repeat=len(sizes)))


@pytest.mark.parametrize("parts", [2, 3])
@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 60), min_size=1, max_size=7))
def test_differencing_is_right_and_near_the_best(sizes, parts):
    sums = np.zeros((len(sizes), parts), np.int64)
    sums[:, 0] = sizes
    final, place = difference(sums)
    dealt = np.bincount(place[:, 0], sizes, parts)
    assert sorted(dealt.tolist(), reverse=True) == final.tolist() and final.sum() == sum(sizes)
    best = spread_of(sizes, parts)
    assert best <= final[0] - final[-1] <= max(best, max(sizes))


def test_differencing_by_hand():
    sums = np.zeros((5, 2), np.int64)
    sums[:, 0] = [8, 7, 6, 5, 4]
    assert difference(sums)[0].tolist() == [16, 14]
