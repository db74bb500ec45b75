"""The exact bounds that rule out pairs before their sets are compared, and a large group of similar unlinked texts."""

import random

import numpy as np
import pytest

from clinspark.llm.minhash import FEWEST_BITS, NearDuplicates, bit_maps, near_duplicates
from clinspark.llm.text import starts_of

from .test_operators import brute_components


@pytest.mark.parametrize("size", [1, 40, 127, 128, 129, 700, 6000])
def test_bit_maps_never_overstate_what_is_missing(size):
    rng = np.random.default_rng(size)
    pool = rng.integers(0, 2**64 - 1, 2 * size, dtype=np.uint64)
    for other in (size, max(1, size * 4 // 5)):
        a, b = (np.unique(rng.choice(pool, n, replace=False)) for n in (size, other))
        x, y = (m.view(np.uint64) for m in bit_maps(np.concatenate([a, b]), starts_of(np.array([len(a), len(b)]))))
        width = min(len(x), len(y))
        x, y = ((m[:width] | m[width:]) if len(m) > width else m for m in (x, y))
        assert max(len(x), len(y)) == width
        assert int(np.bitwise_count(x & ~y).sum()) <= len(np.setdiff1d(a, b))
        assert int(np.bitwise_count(x).sum()) <= len(a)


def test_map_of_an_empty_set():
    empty, one = bit_maps(np.array([5], dtype=np.uint64), np.array([0, 0, 1]))
    assert not empty.any() and len(empty) == FEWEST_BITS // 64 and np.bitwise_count(one.view(np.uint64)).sum() == 1


def test_large_group_of_similar_texts_around_the_threshold(llm):
    """Copies of one text with a few words changed, so that most pairs are just below or just above the similarity."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(130)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(len(base)), rng.choice([2, 3, 4, 5])):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[rng.randrange(3):])))
    want = brute_components(rows, 4, 80)
    assert 1 < len({c for _, c in want.values()}) < len(rows)
    found = near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"), NearDuplicates(words=4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
