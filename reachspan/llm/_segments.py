"""Anchored segments: how equal windows of consecutive units, in any documents, are brought together.

Every window of `window` units holds some runs of k units; the one with the smallest hash (the first of equal
ones) is its anchor.  Successive windows mostly share their anchor, and the units that such a group of windows
covers are a segment.  Equal windows have equal anchors at equal places, so windows need comparing only within
segments of one anchor: one record for about (window - k) / 2 windows.
"""

from __future__ import annotations

import numpy as np

from . import _text as X
from .decontaminate import sliding_min


class Segments:
    """Of each segment: row, anchor's hash, content's hash, begin (unit within the row), number of windows, place of the anchor in it."""

    def __init__(self, units: np.ndarray, at: np.ndarray, window: int, k: int):
        self.sums = X.prefix(units)
        n = len(units) - window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            self.row = self.begin = self.windows = self.place = none
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        bits = max(1, len(units).bit_length())
        low = np.uint64((1 << bits) - 1)
        spot = np.arange(len(units) - k + 1)
        run = X.span_hash(self.sums, spot, spot + k)
        order = (run & ~low) | spot.astype(np.uint64)
        least = (sliding_min(order, window - k + 1)[:n] & low).astype(np.int64)
        row_end = np.repeat(at[1:], np.diff(at))
        first = np.flatnonzero(np.arange(window, n + window) <= row_end[:n])
        anchor = least[first]
        head = np.ones(len(first), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
        heads = np.flatnonzero(head)
        self.windows = np.diff(np.append(heads, len(first)))
        begin, anchor = first[heads], anchor[heads]
        self.row = np.searchsorted(at, begin, side="right") - 1
        self.begin, self.place = begin - at[self.row], anchor - begin
        self.anchor = run[anchor]
        shape = (self.place.astype(np.uint64) << np.uint64(32)) | self.windows.astype(np.uint64)
        self.content = X.mix(X.span_hash(self.sums, begin, begin + self.windows - 1 + window) ^ X.mix(shape))
