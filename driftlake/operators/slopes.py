"""Slopes between all pairs of a series' points, without making the pairs.

How many pairs have a slope below some value is how many pairs stand in the wrong order when the points are sorted by x and
looked at along that slope; such inversions are counted in n log n. So the slope of any rank is found by halving an
interval of slopes. Short series are looked at pair by pair. A series is one pair of arrays of doubles in its task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Points up to which all pairs are made.
PAIRWISE = 1500


def inversions(values: np.ndarray) -> int:
    """How many pairs stand in descending order. From the highest bit of the ranks to the lowest, the ones that stand before
    a zero are counted within each group of equal higher bits, and zeros are put first."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    total = 0
    for bit in range(n.bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        start = rank >> (bit + 1) << (bit + 1)
        before = np.cumsum(one) - one
        before -= before[start]
        total += int(before[one == 0].sum())
        zeros = np.minimum(1 << bit, n - start)
        place = np.where(one == 0, np.arange(n) - before, start + zeros + before)
        moved = np.empty(n, np.int64)
        moved[place] = rank
        rank = moved
    return total


def pair_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All slopes between points of different x, sorted."""
    a, b = np.triu_indices(len(x), 1)
    dx = x[b] - x[a]
    apart = dx != 0
    return np.sort((y[b] - y[a])[apart] / dx[apart])


class Slopes:
    """The ordered slopes between all points of different x of a series."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        self.x, self.y = x[order], y[order]
        times = np.unique(self.x, return_counts=True)[1]
        n = len(x)
        self.size = n * (n - 1) // 2 - int((times * (times - 1) // 2).sum())
        self.known = pair_slopes(self.x, self.y) if n <= PAIRWISE else None

    def below(self, slope: float) -> int:
        """How many slopes are less than one."""
        if self.known is not None:
            return int(np.searchsorted(self.known, slope))
        along = self.y - slope * self.x
        return inversions(along[np.lexsort((along, self.x))])

    def at(self, rank: int) -> float:
        """The slope of a rank, from 0: exactly, or for long series to the last bits of a double."""
        if self.known is not None:
            return float(self.known[rank])
        step = np.diff(self.x)
        most = (self.y.max() - self.y.min()) / step[step > 0].min()
        low, high = -most - 1e-300, most + 1e-300
        while True:
            middle = low + (high - low) / 2
            if not low < middle < high or high - low <= 1e-15 * max(abs(low), abs(high)):
                return float(high if low == -high else middle)
            if self.below(middle) <= rank:
                low = middle
            else:
                high = middle

    def median(self) -> float:
        return 0.0 if not self.size else (self.at((self.size - 1) // 2) + self.at(self.size // 2)) / 2


def per_series(pairs: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict], schema: str, key: str = "series") -> DataFrame:
    """One row for each key of (key, x, y): work takes its x and y and gives the columns after the key."""

    def run(table: pa.Table) -> pa.Table:
        found = work(*(table.column(c).to_numpy() for c in ("x", "y")))
        return pa.table({key: table.column(key).slice(0, 1)} | {k: pa.array([v]) for k, v in found.items()})

    points = pairs.select(key, pairs["x"].cast("double").alias("x"), pairs["y"].cast("double").alias("y"))
    return points.groupBy(key).applyInArrow(run, f"{key} {dict(pairs.dtypes)[key]}, {schema}")


def theil_sen(pairs: DataFrame, key: str = "series") -> DataFrame:
    """(key, slope, intercept) of (key, x, y): the median slope between its points (0 without two different x), and the
    median of what it leaves of y."""

    def work(x: np.ndarray, y: np.ndarray) -> dict:
        slope = Slopes(x, y).median()
        return {"slope": slope, "intercept": float(np.median(y - slope * x))}

    return per_series(pairs, work, "slope double, intercept double", key)


def passing_bablok_of(x: np.ndarray, y: np.ndarray) -> dict:
    """Shifted median of the slopes and its 95 % limits; slope 1 if all x are equal."""
    n, slopes = len(x), Slopes(x, y)
    m = slopes.size
    if not m:
        return {"n": n, "slope": 1.0, "intercept": float(np.median(y - x)), "lower": 1.0, "upper": 1.0}
    shift, c = slopes.below(-1.0), 1.96 * np.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    middle, low, high = (int(min(max(k, 1), m)) for k in (shift + (m + 1) // 2, np.rint(shift + (m - c) / 2), np.rint(shift + (m + c) / 2)))
    slope = slopes.at(middle - 1)
    return {"n": n, "slope": slope, "intercept": float(np.median(y - slope * x)), "lower": slopes.at(low - 1), "upper": slopes.at(high - 1)}
