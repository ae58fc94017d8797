"""Findings of the third round: each test failed before."""

import random
import tracemalloc

import numpy as np

from vistagrid.llm import jaccard, quality
from vistagrid.llm.common import tidied


def test_quality_chunk_needs_few_bytes_a_character():
    # pipeline: the keys of a whole chunk, as 64-bit numbers with all steps in between, took an executor over its memory.
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=300)).encode() for _ in range(2000)]
    size = sum(map(len, texts))
    tracemalloc.start()
    grams = quality.Grams(texts)
    keys, n, _, _ = grams.distinct()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grams.direct and n.sum() == size
    assert peak < 20 * size


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def _garbage(size: int, then) -> None:
    """Frees `size` bytes in pieces that the allocator keeps for itself, with one small piece still in use behind them."""
    del (warm := [np.ones(30 << 20, dtype=np.uint8)])[0]  # from now on arrays of this size come from the heap
    pieces = [np.ones(1 << 20, dtype=np.uint8) for _ in range(size >> 20)]
    then.append(np.ones(1 << 16, dtype=np.uint8))
    del pieces


def test_waiting_workers_give_their_memory_back():
    # pipeline: two idle workers of an executor held 240 MB each while two others worked, and the executor passed 3,000 MB.
    held = []
    before = _resident()
    tidied(_garbage)(256 << 20, held)
    assert _resident() - before < 64 << 20
    for fn in (quality._summed, quality._answered, jaccard._signed, jaccard._verified):
        assert fn.__wrapped__
