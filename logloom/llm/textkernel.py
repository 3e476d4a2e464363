"""Words and their hashes over the raw bytes of many texts at once.

All functions work on a slice of texts: its bytes, and the bounds of each text in them.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the 64-bit hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
ORDER = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of True that stays within one text."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets < len(inside))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    last = offsets[offsets > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs are in order and apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(total) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE))
    values = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


#: Bytes whose runs are hashed at once, about; a longer text is cut between runs.
PIECE = 1 << 22


def hashed_runs(inside: np.ndarray, fold: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of bytes that `inside` (a table by byte) is true for, with bytes replaced by `fold`."""
    if len(data) <= PIECE:
        starts, ends, text = runs(inside[data], offsets)
        return run_hashes(fold[data], starts, ends), text
    hashes, texts, start = [], [], 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        if stop < len(data):
            apart = np.flatnonzero(~inside[data[start:stop]])
            if len(apart):
                stop = start + int(apart[-1]) + 1
            else:
                # One run is longer than a piece.
                while stop < len(data) and not len(apart := np.flatnonzero(~inside[data[stop : stop + PIECE]])):
                    stop += PIECE
                stop = min(stop + int(apart[0]) if stop < len(data) else stop, len(data))
        own = np.concatenate(([start], offsets[(offsets > start) & (offsets < stop)], [stop])) - start
        part = data[start:stop]
        starts, ends, _ = runs(inside[part], own)
        hashes.append(run_hashes(fold[part], starts, ends))
        texts.append(np.searchsorted(offsets, starts + start, side="right") - 1)
        start = stop
    return np.concatenate(hashes), np.concatenate(texts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (run of bytes other than ASCII white space), A-Z lower-cased."""
    return hashed_runs(~SPACE, LOWER, data, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct word shingles as 64-bit hashes, sorted, and each text's bounds in them.

    A text with fewer words than `width` has its whole sequence as one shingle; without words it has none.
    """
    n = len(offsets) - 1
    words, text = word_hashes(data, offsets)
    counts = np.bincount(text, minlength=n)
    begins = np.concatenate(([0], np.cumsum(counts)))
    values, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h = mix(h + words[k : len(words) - width + 1 + k] * ORDER[k % 4] + np.uint64(k))
        whole = text[: len(h)] == text[width - 1 :]
        values, owners = h[whole], text[: len(h)][whole]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            there = counts[few] > k
            at = np.minimum(begins[few] + k, len(words) - 1)
            own = np.where(there, mix(own + words[at] * ORDER[k % 4] + np.uint64(1000 + k)), own)
        values, owners = np.concatenate((values, own)), np.concatenate((owners, few))
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(n + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each pair of bounds, modulo 2^64 for unsigned values."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
