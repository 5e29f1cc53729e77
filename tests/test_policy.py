import pytest

from siltstone.operators import policy


@pytest.mark.parametrize(
    ("sizes", "expected"),
    [
        ([100, 110, 95], []),
        ([100, 105, 98, 102], [0, 1, 2, 3]),
        ([100, 105, 98, 102, 10000, 10500], [0, 1, 2, 3]),
        ([100, 100, 100, 201], []),
        ([], []),
        # a tier that skips a generation must not be merged
        ([100, 1000, 100, 100, 100], []),
        ([100, 1000, 100, 100, 100, 100], [2, 3, 4, 5]),
    ],
)
def test_candidates(sizes, expected):
    assert policy.candidates(sizes) == expected


def test_tiers_follow_the_running_minimum():
    assert policy.tiers([100, 1000, 100, 100, 100]) == [[0, 2, 3, 4], [1]]
    assert policy.tiers([100, 200, 50, 110]) == [[0, 1, 2], [3]]


def test_ratio_is_inclusive_and_zero_matches_zero():
    assert policy.similar(100, 200) and not policy.similar(100, 201)
    assert policy.similar(0, 0) and not policy.similar(0, 1)


def test_tombstones_drop_only_from_the_oldest():
    assert policy.may_drop_tombstones([0, 1, 2, 3])
    assert not policy.may_drop_tombstones([2, 3, 4, 5])
    assert not policy.may_drop_tombstones([0, 2, 3, 4])
    assert not policy.may_drop_tombstones([])
