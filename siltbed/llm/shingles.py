"""Distinct word shingles of texts as 64-bit numbers, and MinHash signatures of such sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltbed.llm.wordhash import mixed, normal, word_hashes

WORDS = 5
_FACTORS = np.random.default_rng(23).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The ascending distinct shingles of each text: runs of `words` words, or its whole sequence if it has fewer, or none."""
    for n, data, ends in normal(texts):
        own, word_ends = word_hashes(data, ends)
        runs = np.zeros(0, np.uint64)
        if len(own) >= words:
            runs = own[: len(own) - words + 1] * _FACTORS[0]
            for k in range(1, words):
                runs = runs + own[k : len(own) - words + 1 + k] * _FACTORS[k]
            runs = mixed(runs)
        lo = 0
        for hi in word_ends.tolist():
            if hi - lo >= words:
                yield np.unique(runs[lo : hi - words + 1])
            elif hi > lo:
                with np.errstate(over="ignore"):
                    yield mixed((own[lo:hi] * _FACTORS[words : words + hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
            lo = hi


class MinHash:
    """Signatures: for each coordinate the least of a set's numbers under that coordinate's multiplication."""

    def __init__(self, coordinates: int, seed: int = 29):
        self.factors = (np.random.default_rng(seed).integers(1, 1 << 31, coordinates, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

    def signature(self, own: np.ndarray) -> np.ndarray:
        """One unsigned 32-bit value per coordinate of a non-empty set."""
        x = (own >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(x), 4096):
            np.minimum(out, (self.factors * x[None, lo : lo + 4096]).min(1), out=out)
        return out
