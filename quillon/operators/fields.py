"""Similarities of fields, block against block."""

from __future__ import annotations

import numpy as np
import pandas as pd

ROWS_AT_ONCE = 512
SCHEMA = "sample_id string, similarity double, correlation double"


class _Fields:
    """Means, centred fields, norms and variances; sums run in order, as those of ``vec`` do."""

    def __init__(self, m: np.ndarray):
        self.x = m.astype(np.float64)
        self.mean = np.cumsum(self.x, axis=1)[:, -1] / self.x.shape[1]
        self.off = self.x - self.mean[:, None]
        self.norm = np.sqrt((self.off**2).sum(axis=1))
        self.var = self.norm**2 / self.x.shape[1]


class Best:
    """The best structural similarity and correlation so far of each field of a block, as ``vec`` defines both."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.own = ids, _Fields(m)
        self.similarity, self.correlation = np.full(len(ids), -np.inf), np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, m: np.ndarray, c1: float = 1e-4, c2: float = 9e-4) -> None:
        a, b = self.own, _Fields(m)
        for at in range(0, len(self.ids), ROWS_AT_ONCE):
            i = slice(at, at + ROWS_AT_ONCE)
            dot, means = a.off[i] @ b.off.T, a.mean[i, None] * b.mean
            s = (2 * means + c1) * (2 * dot / m.shape[1] + c2) / ((a.mean[i, None] ** 2 + b.mean**2 + c1) * (a.var[i, None] + b.var + c2))
            d = a.norm[i, None] * b.norm
            with np.errstate(divide="ignore", invalid="ignore"):
                r = dot / d
            flat, other = np.nonzero(d == 0)
            for f in np.unique(flat):
                o = other[flat == f]
                y = b.x[o]
                r[f, o] = (np.abs(a.x[i][f] - y) <= 1e-8 + 1e-5 * np.abs(y)).all(axis=1)
            self.similarity[i] = np.maximum(self.similarity[i], s.max(axis=1))
            self.correlation[i] = np.maximum(self.correlation[i], r.max(axis=1))

    @staticmethod
    def rows(block: int, state: Best) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": state.ids, "similarity": state.similarity, "correlation": state.correlation})
