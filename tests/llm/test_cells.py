"""Dealing rows into many cells."""

import tracemalloc

import numpy as np

from tallyframe.llm.vectors import Cells


def test_dealing_takes_memory_of_a_few_rows_at_a_time():
    rng = np.random.default_rng(3)
    cells, rows = Cells(rng.normal(size=(2048, 16)), 1024, rounds=0), rng.normal(size=(10_000, 16))
    tracemalloc.start()
    own, far, size = cells.nearest(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 10,000 rows against 1,024 cells at once are 80 MB an array
    gap = ((rows[::500, None] - cells.centres[None]) ** 2).sum(2)
    assert (own[::500] == gap.argmin(1)).all() and np.allclose(far[::500] ** 2, gap.min(1), atol=1e-3)
    assert np.allclose(size, np.linalg.norm(rows, axis=1)) and [len(x) for x in cells.nearest(rows[:0])] == [0, 0, 0]
