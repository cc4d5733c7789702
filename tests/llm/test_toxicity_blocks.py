"""Nearest examples from dense tables and lists against plain sums of products, with ties and near ties."""

from collections import Counter

import numpy as np
import pytest

from barcast.llm import toxicity


@pytest.mark.parametrize("room", [toxicity.DENSE_BYTES, 3 * 4 * 8 * 50, 0])
def test_nearest_by_blocks(monkeypatch, room):
    monkeypatch.setattr(toxicity, "DENSE_BYTES", room)
    rng = np.random.default_rng(6)
    settings = toxicity.Settings(neighbours=6, block=8)
    bags = []
    for i in range(400):
        own = {f"t{t:02d}": int(c) for t, c in zip(rng.zipf(1.4, 12) % 60, rng.integers(1, 9, 12))}
        bags.append((i, int(i % 3 == 0), 1.0, bags[i - 7][3] if i % 11 == 10 else {} if i % 50 == 3 else own))  # copies and empty ones
    bags[20] = (20, 0, 1.0, {"t01": 1_000_000, "t02": 1_000_000})
    bags[390] = (390, 0, 1.0, {"t01": 1_000_000, "t02": 1_000_001})  # apart from it by less than single precision
    index = toxicity.build(bags, settings)
    matrix = np.zeros((400, len(index.vocabulary)))
    for i, (_, _, _, bag) in enumerate(bags):
        terms, weights = index.vector(Counter({index.vocabulary[g]: c for g, c in bag.items()}))
        matrix[i, terms] = weights
    for i in range(0, 400, 3):
        terms = np.nonzero(matrix[i])[0]
        for out in (-1, i):
            # in the order of the terms, as rounding to 12 digits does not hide another order's last digits for sure
            cosines = np.round(sum((matrix[i, t] * matrix[:, t] for t in terms), np.zeros(400)), 12)
            want = [(r, c) for c, r in sorted((-c, r) for r, c in enumerate(cosines.tolist()) if c > 0 and r != out)[:6]]
            assert index.nearest(terms, matrix[i, terms], out) == [(r, -c) for r, c in want]
    assert index.blocked.dense.shape[1] <= max(1, room // (4 * 8 * 50))
