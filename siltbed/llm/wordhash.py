"""Words of many texts as 64-bit numbers, in numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000
SPACE, END = 0x20, 0x0A

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(how many texts, bytes, where each text ends) by slices of bounded size, or of one text.

    A text becomes its words with A-Z in lower case, each followed by one space; null is no word."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    held, size = [], 0
    for x in texts:
        words = x.as_py().lower().split()
        own = b" ".join(words) + b" " if words else b""
        held.append(own)
        size += len(own)
        if size > SLICE:
            yield len(held), b"".join(held), np.cumsum([len(y) for y in held])
            held, size = [], 0
    if held:
        yield len(held), b"".join(held), np.cumsum([len(y) for y in held])


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each word, where each text's words end) of what normal() yields."""
    b = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(b == SPACE)
    power, inverse = _powers(len(b) + 1)
    sums = np.cumsum(_BYTES[b] * power[: len(b)], dtype=np.uint64)
    starts = np.append(0, stops[:-1] + 1)[: len(stops)]
    own = (sums[stops] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * inverse[starts]
    return mixed(own), np.searchsorted(stops, ends - 1, "right")
