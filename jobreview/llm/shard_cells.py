"""Cells of vector space: median splits of a bounded sample, with tight boxes.

Every row is dealt to the cell its components lie in. A cell has one box around
all of its rows, so that a query is sent only to cells whose box can reach its
floor. Splits and boxes hold no more numbers a side than the sample, about
``SAMPLE_NUMBERS`` whatever the table holds (a ``LEAF_SAMPLE``-th of it where few
components tie): they travel with the tasks. Vectors of a length
that the sample lacks are one cell without a box, which every query of that
length reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_NUMBERS = 1 << 22
LEAF_SAMPLE = 16
BUCKETS = 1 << 30
BOUNDS_AT_ONCE = 1 << 21
BOX = "cell int, n long, lo array<double>, hi array<double>"


@dataclass
class Splits:
    """One tree of splits per vector length. Inner nodes hold (axis, cut, left,
    right): rows with a component of at most ``cut`` go left; leaves are cells."""

    nodes: list = field(default_factory=list)
    roots: dict[int, int] = field(default_factory=dict)
    n_cells: int = 0

    def grow(self, size: int, sample: np.ndarray, least: int) -> None:
        """Split until a cell has fewer than twice ``least`` sample rows or
        nothing to split by."""
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.nodes)
            if parent < 0:
                self.roots[size] = node
            else:
                self.nodes[parent][side] = node
            box = sample[rows]
            with np.errstate(over="ignore"):
                width = box.max(axis=0) - box.min(axis=0)
            axis = int(np.argmax(width))
            if len(rows) < 2 * least or not width[axis] > 0:
                self.nodes.append(self.n_cells)
                self.n_cells += 1
                continue
            x = np.sort(box[:, axis])
            cut = x[len(x) // 2 - 1]
            if cut == x[-1]:
                cut = x[np.searchsorted(x, cut) - 1]
            self.nodes.append([axis, float(cut), 0, 0])
            low = box[:, axis] <= cut
            todo.append((rows[~low], node, 3))
            todo.append((rows[low], node, 2))

    def cells(self, size: int, points: np.ndarray) -> np.ndarray:
        """The cell of each point; the length's own cell without a box if it
        has no tree."""
        out = np.full(len(points), -1 - size, np.int32)
        todo = [(self.roots[size], np.arange(len(points)))] if size in self.roots else []
        while todo:
            node, rows = todo.pop()
            at = self.nodes[node]
            if not isinstance(at, list):
                out[rows] = at
                continue
            axis, cut, left, right = at
            low = points[rows, axis] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, stacked vectors) of each length in a column."""
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.array([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at]).reshape(len(at), size)


def fit_splits(rows: DataFrame, shard_rows: int, sample_numbers: int = SAMPLE_NUMBERS) -> Splits:
    """Splits from the rows (vec_id, vec) whose hash falls below the share that
    ``sample_numbers`` components are of all; equal rows count once."""
    total = rows.agg(F.sum(F.size("vec")).alias("numbers")).first()["numbers"] or 0
    share = min(1.0, sample_numbers / max(1, total))
    drawn = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(BUCKETS)) < int(share * BUCKETS)
    sample = rows.filter(drawn).select("vec_id", "vec").distinct().toPandas()
    splits = Splits()
    for size, _, points in by_length(sample["vec"]):
        if size:
            splits.grow(size, points, max(LEAF_SAMPLE, int(share * shard_rows / 2)))
    return splits


def cell_of(splits: Splits, vec: Column) -> Column:
    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        for size, at, points in by_length(vectors):
            out[at] = splits.cells(size, points)
        return pd.Series(out)

    return cell(vec)


def _partial_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One box per cell and task."""
    boxes: dict[int, list] = {}
    for batch in batches:
        for cell, group in batch.groupby("cell"):
            points = np.array([np.asarray(v, dtype=np.float64) for v in group["vec"]])
            lo, hi = points.min(axis=0), points.max(axis=0)
            known = boxes.setdefault(cell, [0, lo, hi])
            boxes[cell] = [known[0] + len(points), np.minimum(known[1], lo), np.maximum(known[2], hi)]
    if boxes:
        yield pd.DataFrame([(cell, *box) for cell, box in boxes.items()], columns=["cell", "n", "lo", "hi"])


@dataclass
class Boxes:
    """The boxes of all cells, by vector length."""

    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def bounds(self, size: int, at: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        """(positions, cells, their rows, bounds) for some of the queries at a
        time: bounds[i, j] is at least the product of query i with any row of
        cell j, the error of the sum added."""
        cells, n, lo, hi = self.by_size[size]
        most = np.maximum(np.abs(lo), np.abs(hi)).T
        step = max(1, BOUNDS_AT_ONCE // len(cells))
        for start in range(0, len(at), step):
            q = queries[start : start + step]
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                bound += np.abs(q) @ most * (size * 2.0**-50)
            yield at[start : start + step], cells, n, bound


def fit_boxes(dealt: DataFrame) -> Boxes:
    """Tight boxes of the cells (cell, vec), combined in the tasks first; their
    number is bounded by that of the splits."""
    parts = dealt.filter("cell >= 0").select("cell", "vec").mapInPandas(_partial_boxes, BOX)
    sides = parts.select("cell", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "side"))
    sides = sides.groupBy("cell", "axis").agg(
        F.sum("n").alias("n"), F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi")
    )
    whole = sides.groupBy("cell").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("sides")
    )
    rows = whole.select("cell", "n", F.col("sides.lo").alias("lo"), F.col("sides.hi").alias("hi")).toPandas()
    by_size = {}
    for size, at, lo in by_length(rows["lo"]):
        hi = np.array([np.asarray(v, dtype=np.float64) for v in rows["hi"].iloc[at]])
        by_size[size] = (rows["cell"].to_numpy()[at], rows["n"].to_numpy()[at], lo, hi)
    return Boxes(by_size)


def best_cell(boxes: Boxes, vec: Column, k: int) -> Column:
    """The cell with the highest bound among those of more than ``k`` rows (of
    all, if none has)."""

    @F.pandas_udf("int")
    def best(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        for size, at, points in by_length(vectors):
            if size not in boxes.by_size:
                out[at] = -1 - size
                continue
            for some, cells, n, bound in boxes.bounds(size, at, points):
                bound = np.nan_to_num(bound, nan=np.inf)
                if (n > k).any():
                    bound = np.where(n > k, bound, -np.inf)
                out[some] = cells[bound.argmax(axis=1)]
        return pd.Series(out)

    return best(vec)


def reached_cells(boxes: Boxes, vec: Column, floor: Column) -> Column:
    """The cells whose box reaches the floor; all of the length without one."""

    @F.pandas_udf("array<int>")
    def reached(vectors: pd.Series, floors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        least = floors.astype("float64").fillna(-np.inf).to_numpy()
        for size, at, points in by_length(vectors):
            if size not in boxes.by_size:
                for i in at:
                    out[i] = [-1 - size]
                continue
            for some, cells, _, bound in boxes.bounds(size, at, points):
                # Slack for the floor as a double; NaN, from overflow, reaches.
                low = least[some, None]
                away = bound + np.where(np.isfinite(low), np.abs(low) * 2.0**-50, 0) < low
                for i, gone in zip(some, away, strict=True):
                    out[i] = cells[~gone].tolist()
        return pd.Series(out)

    return reached(vec, floor)
