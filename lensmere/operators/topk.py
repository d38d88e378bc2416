"""Keeping the best k per query while scanning, in numpy."""

from __future__ import annotations

import numpy as np


class BestPerQuery:
    """Best k (score, id) pairs for each of n queries; ties go to the lower id."""

    def __init__(self, k: int):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.ids = None
        self.scores = np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.ids is not None:
            query = np.concatenate([self.query, query])
            ids = np.concatenate([self.ids, ids])
            scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - starts < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]

    def add_matrix(self, first_query: int, ids: np.ndarray, scores: np.ndarray,
                   keep: np.ndarray | None = None) -> None:
        """Offer a (queries x rows) score matrix; ``keep`` masks what may be chosen."""
        n = scores.shape[1]
        offered = scores if keep is None else np.where(keep, scores, -np.inf)
        if n > self.k:
            bar = np.partition(offered, n - self.k, axis=1)[:, n - self.k]
            chosen = offered >= bar[:, None]
        else:
            chosen = np.ones_like(offered, dtype=bool)
        chosen &= np.isfinite(offered)
        q, r = np.nonzero(chosen)
        if len(q):
            self.add(q + first_query, ids[r], offered[q, r])
