"""What searches in Arrow batches share: the best rows of each query over a whole task, and rounding as SQL does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are made at once; bounds a worker's memory whatever the number of queries.
CELLS = 1 << 20
#: Rows that wait, at least, until they are sorted in.
WAITING = 1 << 16


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x)


class Best:
    """The ``k`` best of each query, by score and then key: k rows a query, and as many that wait."""

    def __init__(self, n_queries: int, k: int, kind: pa.DataType):
        self.k, self.held = k, (np.empty(0, np.int64), np.empty(0), pa.array([], kind))
        self.waiting: list[tuple] = []
        self.n_waiting = 0
        #: What a score has to reach.
        self.least = np.full(n_queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        if len(query):
            self.waiting.append((query, score, keys))
            self.n_waiting += len(query)
        if self.n_waiting >= max(WAITING, len(self.held[0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Number of the query, score and key of the best rows so far."""
        if not self.waiting:
            return self.held
        rows = [self.held, *self.waiting]
        query, score, keys = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), pa.concat_arrays([r[2] for r in rows])
        place = np.empty(len(keys), np.int64)
        place[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        order = np.lexsort([place, -score, query])
        first = np.searchsorted(query[order], np.arange(len(self.least) + 1))
        order = order[np.arange(len(order)) - first[query[order]] < self.k]
        self.held, self.waiting, self.n_waiting = (query[order], score[order], keys.take(pa.array(order))), [], 0
        n = np.bincount(self.held[0], minlength=len(self.least))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = self.held[1][np.cumsum(n)[full] - 1]
        return self.held
