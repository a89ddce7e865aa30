"""The search of the packing tries more than a few fillings."""

from collections import Counter

from strata.llm.packing import fillings


def test_fillings_are_not_halved():
    sizes = list(range(20, 60))
    assert len(fillings(60, Counter(sizes), sorted(sizes, reverse=True), 160)) > 8
