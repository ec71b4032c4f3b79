"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Every bit of ``x`` spread over all 64 (the finaliser of the splitmix generator)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_KEYS = mixed(np.arange(256, dtype=U), 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U(0xD6E8FEB86659FD93)
_powers = np.ones(1, U)


def powers(count: int) -> np.ndarray:
    """At least ``count`` powers of an odd constant, modulo 2**64."""
    global _powers
    if len(_powers) < count:
        steps = np.full(max(count, 256), _STEP)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=U)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, fold: bool = True):
    """Hashes of the words of each row, and how many words each row has.

    Words are the longest runs of bytes outside ``gap``; a word ends with its row. With ``fold``
    A-Z count as a-z. The hash covers every byte and the length of the word.
    """
    rows = len(offsets) - 1
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    first[edges] = inside[edges]
    places = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), np.zeros(rows, np.int64)
    heads = np.searchsorted(places, starts)
    sizes = np.diff(np.append(heads, len(places)))
    values = BYTE_KEYS[LOWER[data[places]] if fold else data[places]]
    at = np.arange(len(places)) - np.repeat(heads, sizes)
    values *= powers(int(sizes.max()) + 1)[at]
    hashes = mixed(np.add.reduceat(values, heads) + sizes.astype(U) * U(0xA24BAED4963EE407))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word ``size``-grams of each row, rising, and how many each row has.

    A row of fewer words, but not none, has one: its whole sequence.
    """
    keys = mixed(np.arange(size, dtype=U), 7) | U(1)
    n = len(hashes)
    ends = np.cumsum(counts)
    begins = ends - counts
    long_rows = counts >= size
    grams_of = np.where(long_rows, counts - size + 1, np.minimum(counts, 1))
    total = int(grams_of.sum())
    heads = np.cumsum(grams_of) - grams_of
    at = np.arange(total) - np.repeat(heads, grams_of) + np.repeat(begins, grams_of)
    grams = np.zeros(total, U)
    span = np.repeat(np.minimum(counts, size), grams_of)
    for k in range(size):
        here = hashes[np.minimum(at + k, max(n - 1, 0))] * keys[k] if n else grams
        grams += here if not (span <= k).any() else np.where(span > k, here, U(0))
    grams = mixed(grams + span.astype(U))
    bounds = np.append(heads, total)
    for a, b in zip(bounds[:-1][grams_of > 1], bounds[1:][grams_of > 1], strict=True):
        grams[a:b].sort()
    keep = np.ones(total, bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[heads[grams_of > 0]] = True
    kept = np.add.reduceat(keep, heads[grams_of > 0]) if total else np.zeros(0, np.int64)
    sizes = np.zeros(len(counts), np.int64)
    sizes[grams_of > 0] = kept
    return grams[keep], sizes
