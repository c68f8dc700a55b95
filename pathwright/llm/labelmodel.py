"""A generative model of heuristic votes: it learns how accurate each voter is, and which voters go together, without labels."""

from __future__ import annotations

import numpy as np


class LabelModel:
    """Two hidden classes; each voter's vote depends on the class and, where the data show that voters go together beyond the class,
    on one other voter's vote (a tree of dependencies). Fitted by expectation maximisation on vote patterns and their counts.

    votes: (patterns, voters) small integers. The class that is likelier where the first guess is high is 1. Patterns in `never` count
    as class 0 while fitting."""

    def __init__(self, rounds: int = 60, smooth: float = 0.5, dependence: float = 0.01):
        self.rounds, self.smooth, self.dependence = rounds, smooth, dependence
        self.prior = 0.5
        self.parents: list[int] = []

    def fit(self, votes: np.ndarray, counts: np.ndarray, guess: np.ndarray, never: np.ndarray | None = None) -> "LabelModel":
        self.levels = [int(votes[:, v].max()) + 1 for v in range(votes.shape[1])]
        self.parents = [-1] * votes.shape[1]
        open_ = np.ones(len(votes)) if never is None else 1.0 - never
        p = guess.astype(float) * open_
        # dependencies first: without them the rounds would take voters that go together for the class itself
        self._find_dependencies(votes, counts, p)
        for _ in range(self.rounds):
            self._maximise(votes, counts, p)
            p = self.posterior(votes) * open_
        self._find_dependencies(votes, counts, p)
        for _ in range(self.rounds):
            self._maximise(votes, counts, p)
            p = self.posterior(votes) * open_
        return self

    def _maximise(self, votes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> None:
        self.prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
        self.tables = []
        for v, parent in enumerate(self.parents):
            wide = self.levels[parent] if parent >= 0 else 1
            t = np.zeros((2, wide, self.levels[v]))
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=int)
            for c, w in ((0, counts * (1 - p)), (1, counts * p)):
                np.add.at(t[c], (given, votes[:, v]), w)
            # rare combinations lean on the voter's own table
            alone = t.sum(axis=1, keepdims=True) + self.smooth
            alone /= alone.sum(axis=2, keepdims=True)
            t = t + self.smooth * self.levels[v] * alone
            self.tables.append(t / t.sum(axis=2, keepdims=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each pattern."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for v, parent in enumerate(self.parents):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=int)
            for c in (0, 1):
                logs[:, c] += np.log(self.tables[v][c][given, votes[:, v]])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))

    def _find_dependencies(self, votes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> None:
        n = votes.shape[1]
        weight = np.zeros((n, n))
        for a in range(n):
            for b in range(a):
                for w in (counts * (1 - p), counts * p):
                    t = np.zeros((self.levels[a], self.levels[b]))
                    np.add.at(t, (votes[:, a], votes[:, b]), w)
                    if t.sum() <= 0:
                        continue
                    share = t.sum() / max(counts.sum(), 1)
                    t = t / t.sum()
                    x = t * np.log(np.maximum(t, 1e-12) / np.maximum(t.sum(1, keepdims=True) * t.sum(0, keepdims=True), 1e-12))
                    weight[a, b] += share * x.sum()
        weight += weight.T
        inside = {0}
        while len(inside) < n:  # the strongest tree; edges below the threshold are left out
            a, b = max(((a, b) for a in range(n) if a not in inside for b in inside), key=lambda e: weight[e])
            self.parents[a] = b if weight[a, b] >= self.dependence else -1
            inside.add(a)
