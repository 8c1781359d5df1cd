"""Run-length index of a set of phrases: run-compressed BWT, samples at run ends, matching statistics.

The index holds the suffixes of at least SPAN - 1 bytes of all phrases in lexicographic order,
ties in text order. Where neighbours in that order have the same preceding byte, the
predecessor of the suffix one byte to the left is known from them; so predecessors and match
lengths are stored only at the ends of the runs of the BWT and streamed leftwards from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 50


@dataclass
class RunIndex:
    """``heads`` and ``symbols`` are the run-compressed BWT; the samples are (position, predecessor, match length)."""

    heads: np.ndarray
    symbols: np.ndarray
    sampled: np.ndarray
    before: np.ndarray
    length: np.ndarray
    owner: np.ndarray       # phrase of each suffix, in text order
    left: np.ndarray        # bytes left in the phrase at each suffix


def build(text: np.ndarray, sizes: np.ndarray) -> RunIndex:
    """Index phrases of ``sizes`` bytes (SPAN or more each) that lie in ``text`` one after the other."""
    many = sizes - (SPAN - 2)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), many)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at, left = starts[owner] + within, sizes[owner] - within
    depth = int(sizes.max())
    padded = np.concatenate((text + np.uint8(1), np.zeros(depth, np.uint8)))   # UTF-8 has no byte 255; 0 ends a phrase
    grid = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
    grid[np.arange(depth) >= left[:, None]] = 0
    order = np.argsort(grid.view(f"S{depth}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bwt = np.where(within == 0, 0, padded[at - 1])[order]
    head = np.ones(len(bwt), bool)
    head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
    # a window's predecessor follows from its right neighbour's, unless that begins a run or either is too short to be a window
    window = left >= SPAN
    mine = np.flatnonzero(window)
    after = rank[mine + 1]
    sampled = mine[head[after] | (left[mine] == SPAN) | ~window[order[after - 1]]]
    by_rank = order[window[order]]
    place = np.empty(len(order), np.int64)
    place[by_rank] = np.arange(len(by_rank))
    before = np.where(place[sampled] > 0, by_rank[place[sampled] - 1], -1)
    differ = grid[sampled] != grid[before]
    length = np.where(differ.any(1), differ.argmax(1), np.minimum(left[sampled], left[before]))
    length[before < 0] = 0
    heads = np.flatnonzero(head)
    return RunIndex(heads, bwt[heads], sampled, before, length, owner, left)


def matching(index: RunIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, predecessor, match length) of all windows, streamed from the samples right to left."""
    windows = np.flatnonzero(index.left >= SPAN)
    source = np.searchsorted(index.sampled, windows)
    back = index.sampled[source] - windows
    before = index.before[source]
    return windows, np.where(before >= 0, before - back, -1), np.where(before >= 0, index.length[source] + back, 0)


def repeated(text: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per phrase a bit for each of its windows (lowest first): it also occurs in a phrase with a smaller ``first``."""
    index = build(text, sizes)
    windows, before, length = matching(index)
    root = np.arange(len(index.owner))
    linked = length >= SPAN
    root[windows[linked]] = before[linked]
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    least = np.full(len(root), np.iinfo(np.int64).max)
    own = first[index.owner]
    np.minimum.at(least, root[windows], own[windows])
    marked = windows[own[windows] > least[root[windows]]]
    bit = sizes[index.owner[marked]] - index.left[marked]
    return np.bincount(index.owner[marked], 2.0 ** bit, len(sizes)).astype(np.int64)
