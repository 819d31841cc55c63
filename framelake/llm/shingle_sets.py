"""Word shingles of texts as sets of 64-bit numbers, and their circulant MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Words whose numbers a task remembers.
REMEMBERED = 100_000
#: Shingles that one signature step works on.
STEP_SHINGLES = 1 << 15

_known: dict[bytes, int] = {}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters neighbors."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_numbers(words: list[bytes]) -> np.ndarray:
    known = _known
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle numbers of a text.

    Letters A-Z are lowered; words are runs without space and the control characters 9 to 13; a text of fewer than five
    words is one shingle, without words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    numbers = _word_numbers(words)
    width = min(SHINGLE_WORDS, len(numbers))
    at = len(numbers) - width + 1
    out = np.full(at, width, np.uint64)  # the length keeps short sequences apart from whole shingles
    for k in range(width):
        out = _mixed(out + numbers[k : k + at] * _MULTIPLIERS[k])
    return np.unique(out)


def set_key(shingle_set: np.ndarray) -> bytes:
    """A digest that equal sets share."""
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: coordinate ``k`` is the least value of the second permutation over the set after the first
    permutation and a circular shift by ``k``. One row of ``size`` 32-bit numbers per set; sets must not be empty."""
    out = np.empty((len(sets), size), np.uint32)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= STEP_SHINGLES):
            held += len(sets[stop])
            stop += 1
        ends = np.cumsum([len(s) for s in sets[start:stop]])
        _signed(np.concatenate(sets[start:stop]), np.concatenate([[0], ends[:-1]]), out[start:stop])
        start = stop
    return out


def _signed(values: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    # First permutation: of the 64-bit numbers, of which the upper half is the place on a circle of 2**32.
    place = (_mixed(values) >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(out.shape[1]):
        np.subtract(place, np.uint32(k), out=x)  # the shift, around the circle
        # Second permutation: bijective steps on 32 bits.
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of consecutive groups of ``rows`` coordinates, different for every group."""
    n, size = signature.shape
    parts = signature.reshape(n, size // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(size // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(rows):
        out = _mixed(out + parts[:, :, k] * _MULTIPLIERS[k % len(_MULTIPLIERS)])
    return out.view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets, each not empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether two sets have ``100 * intersection >= percent * union``; empty sets are linked with nothing."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int(np.isin(small, large, assume_unique=True).sum()) if len(large) < 16 * len(small) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)
