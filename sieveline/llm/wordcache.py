"""Values of words, computed once for each distinct word of a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kernels import word_hashes

#: Distinct words a task keeps before it starts anew.
MOST = 1_000_000


class WordCache:
    """word -> a float32 row, by the hash of the word's bytes."""

    def __init__(self, value: Callable[[list[str]], np.ndarray], width: int, most: int = MOST):
        self.value, self.most = value, most
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, self.rows.shape[1]), np.float32)
        every = word_hashes(data, starts, ends)
        values, first = np.unique(every, return_index=True)
        if len(self.hashes) > self.most:
            self.hashes, self.rows = self.hashes[:0], self.rows[:0]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
            new = first[self.hashes[at] != values]
        else:
            new = first
        if len(new):
            raw = data.tobytes()
            rows = self.value([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            hashes = np.concatenate((self.hashes, every[new]))
            order = np.argsort(hashes)
            self.hashes, self.rows = hashes[order], np.concatenate((self.rows, rows.astype(np.float32)))[order]
        return self.rows[np.searchsorted(self.hashes, every)]
