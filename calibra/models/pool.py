"""Pooling counts over a tree of cells.

Every node of the tree has a count model of its own windows. A node's evidence says how well
it predicts as one block, the present window included; going up, a node is either a block (prior
rho) or the product of its children; going down, each leaf gets a mixture of the predictions of its ancestors at the
leaf's share of their area. Evidence is forgotten at the models' memory.
"""

from __future__ import annotations

import numpy as np

from calibra.functions.special import gammaln
from calibra.models import state
from calibra.models.count import CountBank, CountParams

#: Name under which the part of a region where nothing happens is stored.
EMPTY = ""


class TreePool:
    """Pool over quadtree cells: names where a parent is the name without its last digit."""

    def __init__(self, leaves: list[str], coarsest: int = 1, rho: float = 0.1, par: CountParams = CountParams()) -> None:
        nodes = sorted({leaf[:n] for leaf in leaves for n in range(coarsest + 1, len(leaf) + 1)}, key=lambda c: (-len(c), c))
        self.nodes, self.number = nodes, {c: i for i, c in enumerate(nodes)}
        self.cells, self.leaves = leaves, np.array([self.number[c] for c in leaves])
        depth = max(map(len, leaves))
        self.parent = np.array([self.number.get(c[:-1], -1) for c in nodes])
        self.is_leaf = np.zeros(len(nodes), bool)
        self.is_leaf[self.leaves] = True
        self.log_area = np.array([np.log(4.0) * (depth - len(c)) for c in nodes])
        self.paths = [[i for i in self._up(leaf)] for leaf in self.leaves]
        self.missing = np.array([0 if self.is_leaf[i] else 4 - int((self.parent == i).sum()) for i in range(len(nodes))])
        self.bank, self.score, self.rho, self.par = CountBank(len(nodes), par), np.zeros(len(nodes)), rho, par
        # the part of a node where nothing ever happened is one model of zeros
        self.empty, self.empty_score = CountBank(1, par), 0.0

    def restore(self, stored: dict[str, tuple[float, bytes]]) -> None:
        """Go on from (evidence, model state) of nodes; a node without one is new: its region was empty so far."""
        if EMPTY in stored:
            self.empty_score, blob = stored[EMPTY]
            self.empty, _ = state.count_state(blob, self.par)
        self.score[:] = self.empty_score
        for node, i in self.number.items():
            if node in stored:
                self.score[i], blob = stored[node]
                one, _ = state.count_state(blob, self.par)
                for name in ("a", "b", "logw", "hours", "days", "windows"):
                    getattr(self.bank, name)[i] = getattr(one, name)[0]

    def stored(self, last: int) -> dict[str, tuple[bool, float, bytes]]:
        """(is a cell, evidence, model state) of each node and of the empty region; last: the start of the last window."""
        found = {node: (bool(self.is_leaf[i]), float(self.score[i]), state.count_bytes(self.bank, i, last)) for node, i in self.number.items()}
        return found | {EMPTY: (False, float(self.empty_score), state.count_bytes(self.empty, 0, last))}

    def _up(self, i: int):
        while i >= 0:
            yield int(i)
            i = self.parent[i]

    def weights(self) -> list[np.ndarray]:
        """For each leaf, the weights of the nodes on its path, leaf first."""
        z, child_sum = np.zeros(len(self.nodes)), self.missing * self.empty_score
        for i in range(len(self.nodes)):  # deepest first
            z[i] = self.score[i] if self.is_leaf[i] else np.logaddexp(np.log(self.rho) + self.score[i], np.log1p(-self.rho) + child_sum[i])
            if self.parent[i] >= 0:
                child_sum[self.parent[i]] += z[i]
        as_block = np.where(self.is_leaf, 1.0, np.exp(np.minimum(0.0, np.log(self.rho) + self.score - z)))
        out = []
        for path in self.paths:
            reach, w = 1.0, np.zeros(len(path))
            for j in range(len(path) - 1, -1, -1):
                w[j] = reach * as_block[path[j]]
                reach *= 1 - as_block[path[j]]
            out.append(w / w.sum())
        return out

    def step(self, ts: int, leaf_counts: np.ndarray, seconds: float) -> tuple[np.ndarray, np.ndarray]:
        """(F(y-1), F(y)) of each leaf's count in the next window."""
        y = np.zeros(len(self.nodes), np.int64)
        for leaf, path in enumerate(self.paths):
            y[path] += leaf_counts[leaf]
        known = self.bank.windows > 0
        self.bank.discount(seconds)
        self.empty.discount(seconds)
        e = self.bank.exposure(ts)
        pmf, _ = self.bank.predictive(y, e)
        keep = np.exp(-seconds / self.par.memory)
        own = np.log(np.maximum((np.exp(self.bank.logw) * pmf).sum(1), 1e-300))
        self.score = keep * self.score + np.where(known, own + gammaln(y + 1.0) - y * self.log_area, 0.0)
        none = np.zeros(1, np.int64)
        empty_pmf, _ = self.empty.predictive(none, np.ones(1))
        self.empty_score = keep * self.empty_score + (float(np.log((np.exp(self.empty.logw) * empty_pmf).sum())) if self.empty.windows[0] else 0.0)
        lo, hi = np.full(len(self.paths), 0.5), np.full(len(self.paths), 0.5)
        if known.any():
            # one prediction for each (leaf, node on its path), at the leaf's share of the node
            flat = np.concatenate([np.array(p) for p in self.paths])
            owner = np.repeat(np.arange(len(self.paths)), [len(p) for p in self.paths])
            part = CountBank(len(flat), self.par)
            part.a, part.b, part.logw = self.bank.a[flat], self.bank.b[flat], self.bank.logw[flat]
            share = np.exp(self.log_area[self.leaves][owner] - self.log_area[flat])
            point, below = part.predictive(leaf_counts[owner], e[flat] * share)
            w = np.exp(part.logw)
            weight = np.concatenate(self.weights()) * known[flat]
            total = np.bincount(owner, weight, len(self.paths))
            some = total > 0
            lo[some] = (np.bincount(owner, weight * (w * below).sum(1), len(self.paths)) / np.where(some, total, 1.0))[some]
            hi[some] = lo[some] + (np.bincount(owner, weight * (w * point).sum(1), len(self.paths)) / np.where(some, total, 1.0))[some]
        self.bank.learn(ts, y, e, np.where(known[:, None], pmf, 1.0))
        self.empty.learn(ts, none, np.ones(1), empty_pmf if self.empty.windows[0] else np.ones_like(empty_pmf))
        return np.clip(lo, 0, 1), np.clip(hi, 0, 1)
