"""Suffix order of one block by difference cover (DC3), and its repeated windows."""

from __future__ import annotations

import numpy as np

# Three names, or two letters and a name, must fit into 63 bits.
MAX_BLOCK = 2_000_000
LETTER = 8


def _names(keys: np.ndarray) -> np.ndarray:
    """1 for the smallest key, equal names for equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    return names


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``s`` (numbers from 1) in order.

    The positions not divisible by three are the sample. Their triples are
    sorted and named; if names repeat, the string of names is sorted by
    recursion. The other suffixes are sorted by first letter and rank of the
    rest, and merged.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    size = int(s.max()) + 1
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _names((t[sample] * size + t[np.minimum(sample + 1, n)]) * size + t[np.minimum(sample + 2, n)])
    if names.max() < len(sample):
        order = suffix_order(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    top = len(sample) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    by_rank = np.empty(len(sample), np.int64)
    by_rank[names - 1] = sample

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1], kind="stable")]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    first_keys = t[first] * top + rank[np.minimum(first + 1, n + 2)]
    second_keys = (t[second] * size + t[second + 1]) * top + rank[second + 2]
    before = np.searchsorted(first_keys, t[rest] * top + rank[rest + 1])
    before = before + np.searchsorted(second_keys, (t[rest] * size + t[rest + 1]) * top + rank[rest + 2])
    merged = np.empty(len(sample) + len(rest), np.int64)
    at = np.arange(len(rest)) + before
    free = np.ones(len(merged), bool)
    merged[at], free[at] = rest, False
    merged[free] = by_rank
    return merged[merged < n]


def repeated_windows(block: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start, whether another start has the same ``width`` bytes.

    Letters are eight bytes, so a suffix stands in the string of every eighth
    letter of its residue; the strings of all residues are sorted as one. Equal
    windows are then neighbours among the starts, and neighbours are compared
    byte by byte.
    """
    n = len(block)
    padded = np.concatenate([block, np.zeros(LETTER, np.uint8)])
    words = np.zeros(n, np.uint64)
    for i in range(LETTER):
        words = (words << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    where = np.concatenate([np.arange(r, n, LETTER) for r in range(min(LETTER, n))])
    letters = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    order = where[suffix_order(letters[where])]
    index = np.full(n, -1, np.int64)
    index[starts] = np.arange(len(starts))
    order = order[index[order] >= 0]
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for i in range(0, width, LETTER):
        at = min(i, width - LETTER)
        same = same[words[a[same] + at] == words[b[same] + at]]
    out = np.zeros(len(starts), bool)
    out[index[a[same]]] = True
    out[index[b[same]]] = True
    return out
