"""The median of all pairwise slopes of a long series, selected instead of listed.

Of the pairs (i before j), those with a slope below s are the inversions of z - s * hours.  So the median is narrowed down between two slopes by
counting inversions, which a merge does in n log n, and by drawing pairs at random from those still between; when few are left they are listed.
Nothing holds all pairs: memory is in proportion to n log n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are listed; between two slopes that leave more, pairs are drawn.
_LISTED, _DRAWN = 1 << 16, 4096


class Inversions:
    """The pairs (a before b) of a sequence with value[b] < value[a], level by level of a merge, countable and addressable without listing them."""

    def __init__(self, value: np.ndarray) -> None:
        n = len(value)
        rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
        at, self.levels, size = np.arange(n), [], 1
        while size < n:
            place = np.arange(n)
            key = place // (2 * size) * (n + 1) + rank[at]
            left = place // size % 2 == 0
            others, own = at[~left], at[left]
            begin = np.searchsorted(key[~left], place[left] // (2 * size) * (n + 1))
            count = np.searchsorted(key[~left], key[left]) - begin
            some = count > 0
            self.levels.append((own[some], others, begin[some], np.cumsum(count[some])))
            at, size = at[np.argsort(key, kind="stable")], 2 * size
        self.ends = np.cumsum([upto[-1] if len(upto) else 0 for *_, upto in self.levels], dtype=np.int64)
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of these numbers, 0 to total - 1."""
        first, second = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        level = np.searchsorted(self.ends, numbers, "right")
        for k, (own, others, begin, upto) in enumerate(self.levels):
            here = level == k
            m = numbers[here] - (self.ends[k] - upto[-1] if len(upto) else 0)
            i = np.searchsorted(upto, m, "right")
            before = np.where(i > 0, upto[i - 1] if len(upto) else 0, 0)
            first[here], second[here] = own[i], others[begin[i] + m - before]
        return first, second


def median_slope(hours: np.ndarray, z: np.ndarray, seed: int = 7) -> float:
    """The median of (z[j] - z[i]) / (hours[j] - hours[i]) over all pairs of unequal hours; of an even number the mean of the middle two; 0 of none."""
    order = np.lexsort([z, hours])  # equal hours by z: never an inversion, whatever the slope
    h, z = hours[order].astype(np.float64), z[order].astype(np.float64)
    n = len(h)
    same = np.unique(h, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return 0.0
    slope = lambda i, j: (z[j] - z[i]) / (h[j] - h[i])
    rng = np.random.Generator(np.random.PCG64(seed))

    def select(rank: int) -> float:
        lo, hi, below = None, None, 0  # slopes under lo are ``below`` many; that of the rank is from lo up to, but without, hi

        def between() -> tuple[Inversions, np.ndarray]:
            """The pairs with lo <= slope < hi as inversions of a sequence, and where its places stood; without hi later hours come first, equal ones stay."""
            steep = -np.unique(h, return_inverse=True)[1].astype(np.float64) if hi is None else z - hi * h
            start = np.arange(n) if lo is None else np.argsort(z - lo * h, kind="stable")
            return Inversions(steep[start]), start

        def cut(at: float) -> bool:
            """Narrow the bounds at a slope between them; whether it was one."""
            nonlocal lo, hi, below
            if not ((lo is None or at > lo) and (hi is None or at < hi)):
                return False
            under = Inversions(z - at * h).total
            if under <= rank:
                lo, below = at, under
            else:
                hi = at
            return True

        while True:
            left, start = between()
            few = left.total <= _LISTED
            a, b = left.pairs(np.arange(left.total) if few else rng.integers(0, left.total, _DRAWN))
            a, b = start[a], start[b]
            found = np.sort(slope(np.minimum(a, b), np.maximum(a, b)))
            if few:
                return float(found[min(max(rank - below, 0), len(found) - 1)])
            share, wide = (rank - below + 0.5) / left.total, 4 / np.sqrt(_DRAWN)
            drawn = [float(found[int(np.clip((share + d) * _DRAWN, 0, _DRAWN - 1))]) for d in (0, -wide, wide)]
            if not any([cut(drawn[1]), cut(drawn[2]), cut(drawn[0])]):  # many equal slopes: is it they?
                near = 1e-12 * max(float(np.abs(found).max()), float(np.abs(z).max()) / (h[-1] - h[0]))
                parted = [cut(drawn[0] - near), cut(drawn[0] + near)]
                if not any(parted) or lo is not None and hi is not None and hi - lo <= 2.5 * near:
                    return drawn[0]  # what is left is equal but for rounding

    middle = select((pairs - 1) // 2)
    return middle if pairs % 2 else (middle + select(pairs // 2)) / 2


def with_slopes(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``slope`` per hour to rows with the lists ``hours`` and ``z``; 0 for fewer than ``least`` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                h, z = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("hours", "z"))
                found.append(median_slope(h, z) if len(h) >= least else 0.0)
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "slope"])

    return run
