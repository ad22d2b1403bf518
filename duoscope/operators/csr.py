"""Sparse vectors in Arrow batches: lists of positions and values, a zero is never stored nor touched.

Entities of a side are tables ``(key, pos array<int>, val array<double>)``; positions ascend. Matrices are ``k x width`` arrays;
with a bias their last column belongs to a constant 1 that no vector stores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions import vectors as V

#: Cells of an intermediate block.
CELLS = 4_000_000


def of_dense(table: DataFrame, key: str) -> DataFrame:
    """``(key, pos, val)`` of a table that has these or a dense ``vec``."""
    if "vec" not in table.columns:
        return table.select(key, "pos", "val")
    entries = table.select(key, V.nonzero(F.col("vec").cast("array<double>")).alias("e"))
    return entries.select(key, F.col("e.pos").alias("pos"), F.col("e.value").alias("val"))


def of_entries(table: DataFrame, key: str) -> DataFrame:
    """From lists of ``(pos, value)``."""
    return table.select(key, F.col("entries.pos").alias("pos"), F.col("entries.value").cast("array<double>").alias("val"))


class Batch:
    """Sparse rows of one Arrow batch."""

    def __init__(self, pos: pa.Array, val: pa.Array, width: int, bias: bool):
        self.length = pc.fill_null(pc.list_value_length(pos), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.cols = pos.flatten().to_numpy(zero_copy_only=False)
        self.values = val.flatten().to_numpy(zero_copy_only=False)
        self.n, self.width, self.bias = len(pos), width, bias
        if len(self.cols) != len(self.values):
            raise ValueError("positions and values differ in number")
        if len(self.cols) and (self.cols.min() < 0 or self.cols.max() >= width - bias):
            raise ValueError(f"position outside of a matrix of {width} columns")

    def _blocks(self, k: int) -> Iterator[tuple[int, int, int, int]]:
        """(first row, last row, first value, last value) of blocks of rows with few enough cells."""
        ends, at, start = np.cumsum(self.length), 0, 0
        while at < self.n:
            stop = max(at + 1, int(np.searchsorted(ends, start + max(1, CELLS // k), side="right")))
            end = int(ends[stop - 1])
            yield at, stop, start, end
            at, start = stop, end

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """matrix · x of every row: ``n x k``."""
        by_column = np.ascontiguousarray(matrix.T)
        out = np.zeros((self.n, len(matrix)))
        for a, b, s, e in self._blocks(len(matrix)):
            some = np.flatnonzero(self.length[a:b])
            if len(some):
                starts = (np.cumsum(self.length[a:b]) - self.length[a:b])[some]
                out[a + some] = np.add.reduceat(by_column[self.cols[s:e]] * self.values[s:e, None], starts)
        return out + by_column[-1] if self.bias else out

    def outer_sum(self, g: np.ndarray) -> np.ndarray:
        """Σ g_row ⊗ x_row over the rows: ``k x width``."""
        total = np.zeros((self.width, g.shape[1]))
        for a, b, s, e in self._blocks(g.shape[1]):
            if e > s:
                row = np.repeat(np.arange(a, b), self.length[a:b])
                order = np.argsort(self.cols[s:e], kind="stable")
                cols = self.cols[s:e][order]
                starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
                total[cols[starts]] += np.add.reduceat(g[row[order]] * self.values[s:e][order, None], starts)
        if self.bias:
            total[-1] += g.sum(axis=0)
        return total.T


def lists(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list array, without a Python object per row."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(matrix).ravel()))


def projection(pos: Column, val: Column, matrix: np.ndarray, bias: bool) -> Column:
    """M·x of sparse columns."""
    @F.arrow_udf("array<double>")
    def times(p: pa.Array, v: pa.Array) -> pa.Array:
        return lists(Batch(p, v, matrix.shape[1], bias).times(matrix))

    return times.asNondeterministic()(pos, val)
