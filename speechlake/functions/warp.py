"""Dynamic time warping of many small matrices at once, and of large ones in little memory.

Matrices of a batch are padded to one shape; the recursion only looks up and
left, so padding at the far ends never reaches a result. A pair of more than
``CELLS`` cells is never laid out: its costs are made per anti-diagonal, some
diagonals are kept, and the way back makes those between them again.

Sequences stay flat Arrow buffers; an empty or null one has no cost (null) and
matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

CELLS = 1 << 22


def warp(costs: np.ndarray) -> np.ndarray:
    """Accumulated cost of a stack (pairs, rows, columns), one anti-diagonal per step.

    The first row and column are unreachable except for their common corner,
    which costs nothing.
    """
    _, rows, cols = costs.shape
    total = np.zeros_like(costs)
    total[:, 0, 1:] = np.inf
    total[:, 1:, 0] = np.inf
    for s in range(2, rows + cols - 1):
        i = np.arange(max(1, s - cols + 1), min(rows - 1, s - 1) + 1)
        j = s - i
        best = np.minimum(np.minimum(total[:, i - 1, j], total[:, i, j - 1]), total[:, i - 1, j - 1])
        total[:, i, j] = costs[:, i, j] + best
    return total


def backtrack(total: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest matched column of every row; rows the path does not reach get 0.

    Ties prefer the row above, then the column before, then the diagonal.
    """
    pair = np.arange(len(total))
    i, j = rows - 1, cols - 1
    matched = np.zeros(total.shape[:2], dtype=np.int64)
    live = (i > 0) & (j > 0)
    while live.any():
        p, a, b = pair[live], i[live], j[live]
        matched[p, a] = b
        step = np.argmin(np.stack([total[p, a - 1, b], total[p, a, b - 1], total[p, a - 1, b - 1]]), axis=0)
        i[live] = a - (step != 1)
        j[live] = b - (step != 0)
        live = (i > 0) & (j > 0)
    return matched


def _groups(shapes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of pairs whose padded stack stays within a fixed number of cells."""
    group, height, width = [], 0, 0
    for at, (rows, cols) in enumerate(shapes):
        height, width = max(height, rows), max(width, cols)
        if group and (len(group) + 1) * height * width > CELLS:
            yield group
            group, height, width = [], rows, cols
        group.append(at)
    if group:
        yield group


Cells = Callable[[np.ndarray, np.ndarray], np.ndarray]


def long_warp(rows: int, cols: int, cells: Cells) -> tuple[float, np.ndarray]:
    """End cost and matched columns of one pair; memory grows with its length
    times the square root of it.

    Diagonals are arrays over the row. Every ``step``-th and the one before it
    are kept; from them the way back repeats the recursion, up to its own cell.
    """
    matched = np.zeros(rows, np.int64)

    def following(before: np.ndarray, last: np.ndarray, s: int, top: int, width: int) -> np.ndarray:
        """Diagonal ``s`` from the two before it; rows up to ``top``, columns up to ``width``."""
        out = np.full(rows, np.inf)
        i = np.arange(max(1, s - width), min(top, s - 1) + 1)
        if len(i):
            best = np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
            out[i] = cells(i, s - i) + best
        return out

    before, last = np.full(rows, np.inf), np.full(rows, np.inf)
    last[0] = 0.0
    end, step, kept = rows + cols - 2, isqrt(rows + cols) + 1, [(before, last)]
    for s in range(1, end + 1):
        before, last = last, following(before, last, s, rows - 1, cols - 1)
        if s % step == 0:
            kept.append((before, last))
    i, j = rows - 1, cols - 1
    while i > 0 and j > 0:
        start = (i + j - 1) // step * step
        made = list(kept[start // step])
        for s in range(start + 1, i + j):
            made.append(following(made[-2], made[-1], s, i, j))
        while i > 0 and j > 0 and i + j > start:
            matched[i] = j
            at = i + j - start  # made[k] is diagonal start - 1 + k
            up, side, cross = made[at][i - 1], made[at][i], made[at - 1][i - 1]
            if up <= side and up <= cross:
                i -= 1
            elif side <= cross:
                j -= 1
            else:
                i, j = i - 1, j - 1
    return float(last[rows - 1]), matched


def _solve(shapes: list[tuple[int, int]], cells: Callable[[int], Cells]) -> Iterator[tuple[int, float | None, np.ndarray]]:
    """(place, end cost, matched columns) of every pair.

    ``cells`` gives the costs of a pair at rows and columns; they are made when
    its group is solved, so no more than one group of matrices exists at a time.
    """
    for group in _groups(shapes):
        small = [at for at in group if min(shapes[at]) > 0]
        for at in set(group) - set(small):
            yield at, None, np.zeros(shapes[at][0], np.int64)
        if not small:
            continue
        if len(small) == 1 and shapes[small[0]][0] * shapes[small[0]][1] > CELLS:
            yield small[0], *long_warp(*shapes[small[0]], cells(small[0]))
            continue
        rows = np.array([shapes[at][0] for at in small])
        cols = np.array([shapes[at][1] for at in small])
        stack = np.zeros((len(small), rows.max(), cols.max()))
        for slot, at in enumerate(small):
            stack[slot, : rows[slot], : cols[slot]] = cells(at)(np.arange(rows[slot])[:, None], np.arange(cols[slot])[None, :])
        total = warp(stack)
        matched = backtrack(total, rows.copy(), cols.copy())
        for slot, at in enumerate(small):
            yield at, float(total[slot, rows[slot] - 1, cols[slot] - 1]), matched[slot, : rows[slot]]


class Sequences:
    """Rows of a column of lists of equally long lists, as matrices."""

    def __init__(self, column: pa.Array):
        self.ends, steps = column.offsets.to_numpy(), column.values
        self.steps = steps.offsets.to_numpy()
        self.flat = steps.values.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def size(self, at: int) -> int:
        return int(self.ends[at + 1] - self.ends[at])

    def __getitem__(self, at: int) -> np.ndarray:
        first, last = self.ends[at], self.ends[at + 1]
        return self.flat[self.steps[first] : self.steps[last]].reshape(last - first, -1) if first < last else np.zeros((0, 0))


def _distance(y: np.ndarray, p: np.ndarray) -> Cells:
    """One dimension at a time, so no temporary is larger than the result."""

    def cells(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(i.shape, j.shape))
        for d in range(y.shape[1]):
            gap = y[i, d] - p[j, d]
            total += gap * gap
        return np.sqrt(total)

    return cells


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1, keepdims=True)
    return scores - (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))


# The arguments of these functions should be columns or simple expressions: a
# nested lambda over an outer variable is not evaluated below a Python function.


def _sized(rows: Sequences, cols: Sequences) -> list[tuple[int, int]]:
    return [(rows.size(at), cols.size(at)) for at in range(len(rows))]


def _costs(shapes: list[tuple[int, int]], cells: Callable[[int], Cells]) -> pa.Array:
    made: list = [None] * len(shapes)
    for at, cost, _ in _solve(shapes, cells):
        made[at] = cost
    return pa.array(made, pa.float64())


def _matches(shapes: list[tuple[int, int]], cells: Callable[[int], Cells], valid: pa.Array) -> pa.Array:
    made: list = [None] * len(shapes)
    for at, _, matched in _solve(shapes, cells):
        made[at] = matched.astype(np.int32)
    known = valid.to_pylist()
    return pa.array([m if known[at] else None for at, m in enumerate(made)], pa.list_(pa.int32()))


def _whole(costs: pa.Array) -> tuple[list[tuple[int, int]], Callable[[int], Cells]]:
    """Shapes and cells of matrices that are given."""
    rows = Sequences(costs)
    shapes = [(rows.size(at), rows[at].shape[1]) for at in range(len(rows))]

    def cells(at: int) -> Cells:
        matrix = rows[at]
        return lambda i, j: matrix[i, j]

    return shapes, cells


@F.arrow_udf(DoubleType())
def matrix_cost(costs: pa.Array) -> pa.Array:
    """End value of the accumulated cost of a matrix column."""
    return _costs(*_whole(costs))


@F.arrow_udf(ArrayType(IntegerType()))
def matrix_alignment(costs: pa.Array) -> pa.Array:
    """Matched column of every row of a matrix column."""
    return _matches(*_whole(costs), costs.is_valid())


@F.arrow_udf(
    StructType([StructField("nearest", ArrayType(DoubleType())), StructField("total", ArrayType(DoubleType()))])
)
def distance_profile(a: pa.Array, b: pa.Array) -> pa.Array:
    """For every step of ``a`` the least and the summed Euclidean distance to the
    steps of ``b``; blocks of rows of at most ``CELLS`` cells exist at a time."""
    rows, cols = Sequences(a), Sequences(b)
    nearest, total = [], []
    for at, (n, m) in enumerate(_sized(rows, cols)):
        low, sums = np.full(n, np.nan), np.zeros(n)
        if n and m:
            cells, width, size = _distance(rows[at], cols[at]), np.arange(m)[None, :], max(CELLS // m, 1)
            for start in range(0, n, size):
                block = cells(np.arange(start, min(start + size, n))[:, None], width)
                low[start : start + size], sums[start : start + size] = block.min(axis=1), block.sum(axis=1)
        nearest.append(low)
        total.append(sums)
    kind = pa.list_(pa.float64())
    return pa.StructArray.from_arrays([pa.array(nearest, kind), pa.array(total, kind)], ["nearest", "total"])


def _euclidean(target: pa.Array, pred: pa.Array) -> tuple[list[tuple[int, int]], Callable[[int], Cells]]:
    y, p = Sequences(target), Sequences(pred)
    return _sized(y, p), lambda at: _distance(y[at], p[at])


@F.arrow_udf(DoubleType())
def warp_cost(target: pa.Array, pred: pa.Array) -> pa.Array:
    """Accumulated Euclidean cost of two feature sequences."""
    return _costs(*_euclidean(target, pred))


@F.arrow_udf(ArrayType(IntegerType()))
def align_rows(target: pa.Array, pred: pa.Array) -> pa.Array:
    """Predicted step for every target step of two feature sequences."""
    return _matches(*_euclidean(target, pred), target.is_valid())


def align_frames(phone_weight: float, noise: int | None, scale: float):
    """Column function: predicted frame for every target frame of a silent pair.

    Takes predicted features and class scores, target features and target phones;
    the cost of a noise target is its distance alone.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def align(pred: pa.Array, scores: pa.Array, target: pa.Array, phones: pa.Array) -> pa.Array:
        p, s, y = Sequences(pred), Sequences(scores), Sequences(target)
        ends, labels = phones.offsets.to_numpy(), phones.values.to_numpy(zero_copy_only=False)

        def costs(at: int) -> Cells:
            own, classes = labels[ends[at] : ends[at + 1]].astype(int), _log_softmax(s[at])
            far = _distance(y[at], p[at])

            def cells(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                phone_cost = phone_weight * -classes[j, own[i]] / scale
                if noise is not None:
                    phone_cost = np.where(own[i] == noise, 0.0, phone_cost)
                return 0.5 * far(i, j) / scale + phone_cost

            return cells

        return _matches(_sized(y, p), costs, target.is_valid())

    return align
