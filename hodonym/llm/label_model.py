"""A generative label model over votes of heuristics (-1 no, 0 abstains, 1 yes).

Votes depend on the hidden class and, along a learned tree, on one other vote: after a first fit with independent
votes the pairs with the highest conditional mutual information given the class become the tree's edges, and expectation-maximisation
goes on with the tree. It runs on the counts of the distinct vote patterns, so its cost does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class LabelModel:
    def __init__(self, n_votes: int, prior: float = 0.5, trust: float = 0.75, strength: float = 20.0, least_information: float = 0.01, rounds: int = 200, chances: dict[int, float] | None = None) -> None:
        """``trust`` and ``strength``: the accuracy that each voter is believed to have beforehand, and the number of votes which that belief weighs.

        ``chances``: voter -> how often it says yes, where it speaks, of pairs that have nothing to do with each other, if that has been counted.
        """
        self.m, self.prior, self.rounds, self.least = n_votes, prior, rounds, least_information
        self.strength, self.trust, self.chances = strength, trust, chances or {}
        self.parent: list[int | None] = [None] * n_votes

    def _tables(self, votes: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """P(vote j | parent's vote, class) with the belief beforehand as pseudo-counts; axes: class, parent's vote, vote.

        Whether a voter abstains may depend on the other vote but says nothing of the class.
        """
        out = []
        for j, p in enumerate(self.parent):
            t = np.zeros((2, 3, 3))
            v, q = votes[:, j] + 1, votes[:, p] + 1 if p is not None else np.ones(len(votes), int)
            for y in (0, 1):
                np.add.at(t[y], (q, v), weight[:, y])
            both = t.sum(axis=0)
            silent = (both[:, 1] + 1) / (both.sum(axis=1) + 3)
            for y in (0, 1):
                yes = self.trust if y else 1 - self.trust
                spoken = t[y][:, [0, 2]] + self.strength * np.array([1 - yes, yes])
                if y == 0 and j in self.chances:
                    spoken = np.tile([1 - self.chances[j], self.chances[j]], (3, 1))
                t[y][:, [0, 2]] = spoken / spoken.sum(axis=1, keepdims=True) * (1 - silent)[:, None]
                t[y][:, 1] = silent
            out.append(t)
        return out

    def _score(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            q = votes[:, p] + 1 if p is not None else np.ones(len(votes), int)
            log += np.log(self.tables[j][:, q, votes[:, j] + 1]).T
        top = log.max(axis=1, keepdims=True)
        e = np.exp(log - top)
        return e / e.sum(axis=1, keepdims=True)

    def _em(self, votes: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            weight = post * n[:, None]
            self.tables = self._tables(votes, weight)
            self.prior = float(np.clip(weight[:, 1].sum() / max(n.sum(), 1), 0.01, 0.99))
            new = np.where(self.ruled_out[:, None], [1.0, 0.0], self._score(votes))
            if np.abs(new - post).max() < 1e-6:
                return new
            post = new
        return post

    def _information(self, votes: np.ndarray, weight: np.ndarray, a: int, b: int) -> float:
        total, out = weight.sum(), 0.0
        for y in (0, 1):
            t = np.zeros((3, 3))
            np.add.at(t, (votes[:, a] + 1, votes[:, b] + 1), weight[:, y])
            s = t.sum()
            if s > 0:
                q = t / s
                e = np.outer(q.sum(1), q.sum(0))
                k = q > 0
                out += s / total * float(np.sum(q[k] * np.log(q[k] / e[k])))
        return out

    def fit(self, votes: Sequence[Sequence[int]], counts: Sequence[int], ruled_out: Sequence[bool] | None = None) -> "LabelModel":
        """``ruled_out``: patterns that are no match by definition; they stay in the no-match class while all accuracies are learned."""
        self.ruled_out = np.zeros(len(votes), bool) if ruled_out is None else np.asarray(ruled_out, bool)
        v, n = np.asarray(votes, int).reshape(-1, self.m), np.asarray(counts, float)
        yes = 1 / (1 + np.exp(-v.sum(axis=1)))
        yes = np.where(self.ruled_out, 0.0, yes)
        post = self._em(v, n, np.stack([1 - yes, yes], axis=1))
        weight = post * n[:, None]
        edges = sorted(((self._information(v, weight, a, b), a, b) for a in range(self.m) for b in range(a)), reverse=True)
        tree = list(range(self.m))
        near: dict[int, list[int]] = {j: [] for j in range(self.m)}
        for i, a, b in edges:
            if i >= self.least and tree[a] != tree[b]:
                near[a].append(b)
                near[b].append(a)
                tree = [tree[a] if t == tree[b] else t for t in tree]
        seen: set[int] = set()
        for root in range(self.m):
            todo = [(root, None)]
            while todo:
                j, p = todo.pop()
                if j not in seen:
                    seen.add(j)
                    self.parent[j] = p
                    todo += [(k, j) for k in near[j] if k not in seen]
        self._em(v, n, post)
        return self

    def confidence(self, votes: Sequence[Sequence[int]]) -> np.ndarray:
        return self._score(np.asarray(votes, int).reshape(-1, self.m))[:, 1]
