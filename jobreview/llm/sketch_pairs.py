"""Pairs within an inverted list that a union sketch allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SKETCH = 256
RUN_SKETCH = 64
RUN = 3
SMALL_SET = 5  # the largest sets in lists of single values
RUN_SET = 5  # the smallest sets in lists of runs
END = np.int64(1) << np.int64(40)
# Pairs looked at together, by their numbers and by their sketches.
PAIRS = 1 << 19
SKETCH_PAIRS = 1 << 11


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of the union's sketch that both hold, for each row of ``one`` and
    that of ``others``; of the whole union where no sketch is full. Sketches are
    sorted and padded with ``END``."""
    both = np.concatenate([one, others], axis=1)
    both.sort(axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < END)
    rank = np.cumsum(np.concatenate([both[:, :1] < END, ~same & (both[:, 1:] < END)], axis=1), axis=1)
    whole = (one[:, -1] == END) & (others[:, -1] == END)
    most = np.where(whole, rank[:, -1], np.minimum(rank[:, -1], SKETCH))
    return (same & (rank[:, 1:] <= most[:, None])).sum(axis=1) / most


def least_estimates(n: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """The estimate below which the similarity is out of the question: six
    standard deviations under it, next to none for whole sets."""
    share = percent / 100
    drawn = np.where(np.maximum(n, others) < SKETCH, 0.0, np.maximum(1 - SKETCH / (n + others), 0.0))
    return share - 6 * np.sqrt(share * (1 - share) / SKETCH * drawn) - 0.005


def _runs(sketches: np.ndarray) -> np.ndarray:
    """A number for each run of three of the first values, ``END`` past the end."""
    s = sketches[:, :RUN_SKETCH].astype(np.uint64)
    runs = s[:, :-2] * np.uint64(0x9E3779B97F4A7C15) ^ s[:, 1:-1] * np.uint64(0xD1342543DE82EF95) ^ s[:, 2:]
    return np.where(sketches[:, 2:RUN_SKETCH] >= END, np.uint64(0), runs)


def _pairs_of(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j), i < j, of rows with one number in ``group``
    (sorted), a bounded number at a time."""
    ends = np.searchsorted(group, group, "right")
    counts = ends - np.arange(len(group)) - 1
    total = np.cumsum(counts)
    start = 0
    while start < len(group):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        i = np.repeat(np.arange(start, end), counts[start:end])
        first = np.repeat(total[start:end] - counts[start:end] - before, counts[start:end])
        yield i, i + 1 + np.arange(len(i)) - first
        start = end


def list_pairs(
    group: np.ndarray, at: np.ndarray, n: np.ndarray, root: np.ndarray, sketches: np.ndarray, side: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one ``group``, a list or two of its blocks (``side``: 0 where
    all are compared, 1 and 2 for the two blocks), that are not in one component,
    fit in size, meet in no earlier list, and may be alike."""
    runs = _runs(sketches)
    prefix = (sketches[:, : runs.shape[1]] < at[:, None]).sum(axis=1)
    # Sets that are in lists of single values too have no earlier list of runs.
    before = np.where(n > SMALL_SET, prefix, 0)
    for i, j in _pairs_of(group):
        kept = (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j]))
        kept &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        i, j = i[kept], j[kept]
        for start in range(0, len(i), SKETCH_PAIRS):
            x, y = i[start : start + SKETCH_PAIRS], j[start : start + SKETCH_PAIRS]
            # Runs that begin before this list's are other, earlier lists.
            x, y = x[order := np.argsort(before[x], kind="stable")], y[order]
            met = np.zeros(len(x), bool)
            for place in range(int(before[x].max(initial=0))):
                # Only pairs from here on have a run at this place before the list's.
                low = int(np.searchsorted(before[x], place, "right"))
                own, others = runs[x[low:], place], runs[y[low:], : int(prefix[y[low:]].max())]
                met[low:] |= (own != 0) & (others == own[:, None]).any(axis=1)
            x, y = x[~met], y[~met]
            alike = estimates(sketches[x], sketches[y]) >= least_estimates(n[x], n[y], percent)
            yield x[alike], y[alike]


COLUMNS = ("key", "i", "j", "own", "at", "n", "a", "b", "root")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns as arrays; sketches as rows padded with ``END``. They come
    sorted, as the upper halves of sorted hashes."""
    out = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in COLUMNS}
    lists = batch.column("sketch")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out["sketch"] = np.full((len(lists), SKETCH), END, np.int64)
    out["sketch"][np.arange(SKETCH) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); a batch and the group it began in are held
    at a time."""
    names = ("a_a", "a_b", "b_a", "b_b")

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, j, own = rows["i"], rows["j"], rows["own"]
        side = np.where(i == j, 0, np.where(own == i, 1, 2))
        parts = (rows[c] for c in ("at", "n", "root", "sketch"))
        for x, y in list_pairs(groups(rows), *parts, side, percent):
            a, b = rows["a"], rows["b"]
            swap = (a[x] > a[y]) | ((a[x] == a[y]) & (b[x] > b[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[x], b[x], a[y], b[y])], names)

    def groups(rows: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(rows["key"]), bool)
        for name in ("key", "i", "j"):
            new[1:] |= rows[name][1:] != rows[name][:-1]
        return np.cumsum(new)

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        if held:
            rows = {name: np.concatenate([held[name], rows[name]]) for name in rows}
        number = groups(rows)
        last = int(np.searchsorted(number, number[-1]))
        yield from pairs({name: column[:last] for name, column in rows.items()})
        held = {name: column[last:].copy() for name, column in rows.items()}
    if held:
        yield from pairs(held)
