import inspect

import numpy as np
import pytest

from tidemark.llm.bag_minhash import ROWS_PER_BAND, near_duplicates, signatures


def test_two_common_bands_reach_the_stated_recall():
    """Cut buckets ask for two common bands: the default number of bands has to give 3e-6 for that as well."""
    bands = inspect.signature(near_duplicates).parameters["bands"].default
    rng = np.random.default_rng(19)
    pairs, size = 400, 360  # 320 of 400 distinct shingles shared: similarity 0.8
    kept = rng.integers(0, 2**63, (pairs, size + 40), dtype=np.uint64)
    owner, ones = np.repeat(np.arange(pairs), size), np.ones(pairs * size, np.int64)
    a, b = (signatures(owner, v.ravel(), ones, pairs, bands * ROWS_PER_BAND) for v in (kept[:, :size], kept[:, 40:]))
    same = (a == b).reshape(pairs, bands, ROWS_PER_BAND).all(axis=2).mean()
    assert same == pytest.approx(0.8**ROWS_PER_BAND, abs=0.02)
    same = 0.8**ROWS_PER_BAND
    assert (1 - same) ** bands + bands * same * (1 - same) ** (bands - 1) < 3.2e-6
