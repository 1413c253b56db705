"""Thresholds that the bands do not reach are refused."""

import pytest

from sidforge.llm import minhash


@pytest.mark.parametrize("find", [minhash.near_duplicates, minhash.drop_near_duplicates])
def test_low_percents_are_refused(find):
    with pytest.raises(ValueError, match="not from 50"):
        find(None, percent=50)
