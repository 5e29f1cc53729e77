"""Which generations to compact (O-C5..O-C8): size tiers, made safe.

Sizes are listed oldest first.  Files of similar size form tiers; only a run of
neighbours in age may be merged, since skipping a generation could let an old value
shadow a newer one, and tombstones may go only if the run starts at the oldest.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

#: Members that make a tier ready, and the largest size ratio in one.
READY, RATIO = 4, 2.0


def similar(a: int, b: int, ratio: float = RATIO) -> bool:
    """Whether two sizes are within ``ratio`` of each other (inclusive)."""
    low, high = sorted((a, b))
    return high == 0 if low == 0 else high <= ratio * low


def tiers(sizes: Sequence[int], ratio: float = RATIO) -> list[list[int]]:
    """Places by tier: a file joins the first tier to whose smallest file it is similar."""
    smallest: list[int] = []
    members: list[list[int]] = []
    for place, size in enumerate(sizes):
        home = next((t for t, low in enumerate(smallest) if similar(size, low, ratio)), None)
        if home is None:
            smallest.append(size)
            members.append([place])
        else:
            smallest[home] = min(smallest[home], size)
            members[home].append(place)
    return members


def neighbours(places: Sequence[int]) -> list[list[int]]:
    """Maximal runs of consecutive places."""
    runs = groupby(enumerate(sorted(places)), key=lambda x: x[1] - x[0])
    return [[p for _, p in run] for _, run in runs]


def candidates(sizes: Sequence[int], ready: int = READY, ratio: float = RATIO) -> list[int]:
    """Places to compact, or [] if no tier has a run of ``ready`` neighbours."""
    for tier in tiers(sizes, ratio):
        for run in neighbours(tier):
            if len(run) >= ready:
                return run
    return []


def may_drop_tombstones(places: Sequence[int]) -> bool:
    """Only a contiguous run from the oldest generation leaves nothing below."""
    return bool(places) and sorted(places) == list(range(len(places)))
