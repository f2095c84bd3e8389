"""What a worker of the near-duplicate operator holds at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from traceloom.llm import common, near_dup


def test_sets_of_many_texts_take_little_memory(monkeypatch):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = pa.array([" ".join(f"w{(i * 37 + k) % 5000}" for k in range(400)) for i in range(1500)])
    assert texts.nbytes > 3 << 20
    tracemalloc.start()
    try:
        count = sum(len(found) > 0 for found in near_dup.document_sets(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert count == 1500
    assert peak < 32 << 20
