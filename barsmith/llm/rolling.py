"""Rolling hashes, minimisers and super-k-mers over numpy arrays.

A *window* is k consecutive symbols (words or bytes).  Its *minimiser* is the smallest mixed hash among the m-grams
inside it, so equal windows have equal minimisers wherever they stand.  A *super-k-mer* is a run of consecutive windows
of one document that share a minimiser: it is the unit that is dealt over the cluster instead of its many windows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values; a bijection."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(32)
    return x


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, U)
    down = np.full(size, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.lru_cache(maxsize=8)
def byte_codes(salt: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=U) * U(_ODD[salt % 4]) + U(salt))


class Prefix:
    """Polynomial hash, modulo 2**64, of any slice of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, salt: int = 0):
        n = len(codes)
        size = 1 << max(16, int(n + 1).bit_length())
        self.up, self.down = _powers(_ODD[salt % 4], size)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * self.up[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all slices of ``size`` codes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n else np.zeros(0, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:])
    return out


def super_kmers(least: np.ndarray, windows: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs of consecutive windows with one minimiser.

    ``least`` has the minimiser of each window by its start, ``windows`` the ascending starts of those that lie in one
    document with a break (a gap of one start at least) between documents.  Runs of over ``longest`` are cut.
    """
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = least[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(windows) != 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(windows)))
    if len(size) and size.max() > longest:
        parts = -(-size // longest)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + step * longest
        size = np.minimum(longest, np.repeat(size, parts) - step * longest)
    return windows[at], size


def side_keys(views: np.ndarray, least: np.ndarray, gram: int) -> np.ndarray:
    """A key of each window (a row of its grams' hashes) from two further minimisers.

    They are taken by other orders, from grams that overlap neither the first minimiser (``least``, at its leftmost place in
    the window) nor each other.  The key depends on the window alone, so equal windows have equal keys, and it looks where
    windows that share one short passage differ.
    """
    places, last = np.arange(views.shape[1]), np.iinfo(np.uint64).max
    free, at, key = np.ones(views.shape, bool), (views == least[:, None]).argmax(axis=1), np.zeros(len(views), U)
    for salt in _ODD[:2]:
        free &= np.abs(places[None, :] - at[:, None]) >= gram
        values = np.where(free, mix(views ^ U(salt)), last)
        at = values.argmin(axis=1)
        key = mix(key ^ values.min(axis=1))
    return key


def split_crowded(grams: np.ndarray, run: np.ndarray, size: np.ndarray, least: np.ndarray, crowds: tuple[np.ndarray, np.ndarray], width: int, gram: int, window: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs whose minimiser is in ``crowds[0]`` cut to runs with one side key, mixed into their minimisers; those whose mixed
    minimiser is in ``crowds[1]`` cut to windows, under the hash of the whole window (``window(starts)``) instead.

    Returns start, length, minimiser and level (0: not cut, 1: by side keys, 2: single windows) of each run.
    """
    hit = np.isin(least, crowds[0])
    if not hit.any():
        return run, size, least, np.zeros(len(run), np.int8)
    owner, start = _windows(run[hit], size[hit])
    first = least[hit][owner]
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    key = np.concatenate([side_keys(views[start[a : a + 2048]], first[a : a + 2048], gram) for a in range(0, len(start), 2048)])
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    cut, long, mixed = start[at], np.diff(np.append(at, len(key))), mix(first[at] ^ key[at])
    again = np.isin(mixed, crowds[1])
    single = _windows(cut[again], long[again])[1]
    parts = [(run[~hit], size[~hit], least[~hit], 0), (cut[~again], long[~again], mixed[~again], 1), (single, np.ones(len(single), size.dtype), window(single), 2)]
    run, size, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    level = np.repeat(np.array([0, 1, 2], np.int8), [len(p[0]) for p in parts])
    order = np.argsort(run, kind="stable")
    return run[order], size[order], least[order], level[order]


def _windows(run: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the run, and start, of every window."""
    owner = np.repeat(np.arange(len(run)), size)
    return owner, run[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and, for each text, the index of its first word (n + 1)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A word does not cross texts: cut those that do.
    inner = np.unique(offsets[1:-1])
    cut = inner[(np.searchsorted(start, inner, side="left")) > np.searchsorted(end, inner, side="right")]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets, side="left")
