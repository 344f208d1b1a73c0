"""Anchors: places that equal passages share, chosen by content alone.

Of all grams within a window the one with the smallest hash, the first of equal
ones, is the window's anchor. Equal windows have their anchors at the same
offset, so windows need only be compared with those of the same anchor hash.
Consecutive windows with the same anchor form a run.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial of each ``size`` consecutive symbols, from blocks of doubling width."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    result, covered, block, width = None, 0, symbols, 1
    while True:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        if size & width:
            if result is None:
                result = block
            else:
                n = min(len(result), len(block) - covered)
                result = result[:n] * power + block[covered : covered + n]
            covered += width
        if 2 * width > size:
            return result[: len(symbols) - size + 1]
        block = block[:-width] * power + block[width:]
        width *= 2


def window_anchors(hashes: np.ndarray, grams: int) -> np.ndarray:
    """The place of the smallest hash, the first of equal ones, of each ``grams`` consecutive ones."""
    value, place, width = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while width < grams:
        step = min(width, grams - width)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    return place


def runs(
    symbols: np.ndarray, left: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``start, windows, anchor, content`` of each run of windows with the same anchor.

    ``left`` counts the symbols from each place to the end of its document; windows
    that reach beyond it do not count. ``content`` is a hash of the run's symbols:
    its first and last window overlap, so their hashes stand for all of it.
    """
    count = len(symbols) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = mixed(gram_hashes(symbols, gram))
    anchor = window_anchors(hashes, window - gram + 1)
    whole = left[:count] >= window
    new = whole.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    ends = whole.copy()
    ends[:-1] &= new[1:] | ~whole[1:]
    start, last = np.flatnonzero(new), np.flatnonzero(ends)
    full = gram_hashes(symbols, window)
    windows = last - start + 1
    content = mixed(full[start] + windows.astype(np.uint64)) ^ (full[last] * np.uint64(_BASE))
    return start, windows, hashes[anchor[start]], mixed(content)
