"""Rows are given to cells a few hundred at a time, so a worker's memory doesn't follow rows times cells."""

import tracemalloc

import numpy as np

from surveymend.operators.vectors import nearest_pivot


def test_memory_of_many_cells():
    rng = np.random.default_rng(4)
    x, pivots = rng.normal(size=(10_000, 16)), rng.normal(size=(1024, 16))
    tracemalloc.start()
    cell, far = nearest_pivot(x, pivots)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    some = rng.choice(len(x), 50, replace=False)
    apart = np.sqrt(((x[some, None] - pivots) ** 2).sum(axis=2))
    assert (cell[some] == apart.argmin(axis=1)).all() and np.allclose(far[some], apart.min(axis=1))
    assert nearest_pivot(x[:0], pivots)[0].shape == (0,)
