"""Ball trees over integer vectors, searched for many queries at once by branch and bound on inner products."""

from __future__ import annotations

import numpy as np

#: Vectors of a leaf.
LEAF = 64
#: Of no vector; scores lie above.
NONE = -(1 << 62)
LAST = np.iinfo(np.int64).max


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in two halves along the line between two far ones."""
    a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    b = x[np.argmax(((x - a) ** 2).sum(1))]
    by = np.argpartition(x @ (b - a), len(x) // 2)
    return by[: len(x) // 2], by[len(x) // 2 :]


class BallTree:
    """Nodes in preorder: a centre and a radius, the rows from begin to end, the place of the right child (0: a leaf) and the one
    label of all rows, or its lack. Labels with a leaf's rows or more have trees of their own, the others one together."""

    FIELDS = ("ids", "labels", "x", "centre", "radius", "begin", "end", "right", "label", "mixed", "roots")

    def __init__(self, **arrays: np.ndarray):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])
        self.norm = _norms(self.centre)
        self.floats = self.x.astype(np.float64)
        self.longest = float(_norms(self.floats).max(initial=0))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> BallTree:
        floats, order, nodes, roots = x.astype(np.float64), [], [], []
        names, which, count = np.unique(labels, return_inverse=True, return_counts=True)
        groups = [np.flatnonzero(which == i) for i in np.flatnonzero(count >= LEAF)]
        small = np.flatnonzero(count[which] < LEAF)
        placed = 0
        for rows in [*groups, *([small] if len(small) else [])]:
            roots.append(len(nodes))
            stack = [(rows, -1)]
            while stack:
                rows, parent = stack.pop()
                if parent >= 0:
                    nodes[parent][3] = len(nodes)
                p = floats[rows]
                centre = p.mean(0)
                one = labels[rows[0]]
                mixed = bool((labels[rows] != one).any())
                node = [placed, 0, (centre, float(_norms(p - centre).max()) * (1 + 1e-9)), 0, one, mixed, len(rows)]
                nodes.append(node)
                if len(rows) <= LEAF:
                    order.append(rows)
                    placed += len(rows)
                else:
                    a, b = _halves(p)
                    stack += [(rows[b], len(nodes) - 1), (rows[a], -1)]
        for node in nodes:
            node[1] = node[0] + node[6]
        by = np.concatenate(order) if order else np.zeros(0, np.int64)
        col = lambda i, t: np.array([n[i] for n in nodes], t)
        centre = np.array([n[2][0] for n in nodes], np.float64).reshape(len(nodes), x.shape[1])
        radius = np.array([n[2][1] for n in nodes], np.float64)
        return cls(ids=ids[by], labels=labels[by], x=x[by], centre=centre, radius=radius, begin=col(0, np.int64), end=col(1, np.int64), right=col(3, np.int64), label=col(4, np.int64), mixed=col(5, bool), roots=np.array(roots, np.int64))


class Search:
    """Queries and the best rows so far of each, over as many trees as are given. A row counts for a query if its label is the
    query's (same) or differs, if its id isn't the query's, and if its score lies between low and high."""

    def __init__(self, ids, labels, x, same: bool, most: int, low=None, high=None, of=None):
        self.ids, self.labels, self.x, self.same, self.most = ids, labels, x, same, most
        self.floats = x.astype(np.float64)
        self.norm = _norms(self.floats)
        #: Which vector each query has; several may share one.
        self.of = np.arange(len(ids)) if of is None else of
        n = len(self.of)
        self.low = np.full(n, NONE + 1) if low is None else low
        self.high = np.full(n, LAST) if high is None else high
        self.score = np.full((n, most), NONE)
        self.found = np.full((n, most), LAST)
        self.least = np.full(n, NONE)  # scores beneath are known not to matter
        self.opened = self.pruned = 0

    def scores(self, of: np.ndarray, x: np.ndarray, floats: np.ndarray, longest: float) -> np.ndarray:
        """Inner products, exact: by doubles where they can't exceed 2**53. Shorter vectors have zeros where others go on."""
        d = min(self.x.shape[1], x.shape[1])
        if len(of) and float(self.norm[of].max()) * longest < 2**52:
            return (self.floats[of, :d] @ floats[:, :d].T).astype(np.int64)
        return self.x[of, :d] @ x[:, :d].T

    def counts(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> np.ndarray:
        of = self.of[q]
        fits = (labels == self.labels[of, None]) if self.same else (labels != self.labels[of, None])
        return fits & (ids != self.ids[of, None]) & (s >= np.maximum(self.low, self.kth())[q, None]) & (s <= self.high[q, None])

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def _scored(self, q: np.ndarray, x, floats, longest) -> np.ndarray:
        own, back = np.unique(self.of[q], return_inverse=True)
        return self.scores(own, x, floats, longest)[back]

    def seed(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Bounds from some rows of the table: as many of them as are wanted score this much."""
        if len(ids) < self.most or not len(self.of):
            return
        floats = x.astype(np.float64)
        q = np.arange(len(self.of))
        for some in np.array_split(q, max(1, len(q) * len(ids) >> 22)):
            s = self._scored(some, x, floats, float(_norms(floats).max(initial=0)))
            s = np.where(self.counts(some, ids, labels, s), s, NONE)
            self.least[some] = np.partition(s, -self.most, axis=1)[:, -self.most]

    def add(self, tree: BallTree) -> None:
        d = min(self.x.shape[1], tree.x.shape[1])
        stack = [(int(r), np.arange(len(self.of))) for r in tree.roots]
        while stack:
            node, q = stack.pop()
            of = self.of[q]
            if not tree.mixed[node]:
                q = q[(self.labels[of] == tree.label[node]) == self.same]
                of = self.of[q]
            middle, reach = self.floats[of, :d] @ tree.centre[node, :d], self.norm[of] * tree.radius[node]
            slack = 1e-9 * self.norm[of] * (tree.norm[node] + tree.radius[node]) + 1e-3
            may = (middle + reach + slack >= np.maximum(self.kth()[q], self.low[q])) & (middle - reach - slack <= self.high[q])
            self.opened += int(may.sum())
            self.pruned += len(may) - int(may.sum())
            q = q[may]
            if not len(q):
                continue
            right = int(tree.right[node])
            if right:
                # the child nearer to most of the queries is opened first
                a, b = ((self.floats[self.of[q], :d] @ tree.centre[c, :d]).sum() for c in (node + 1, right))
                stack += [(right, q), (node + 1, q)] if a >= b else [(node + 1, q), (right, q)]
                continue
            rows = slice(int(tree.begin[node]), int(tree.end[node]))
            ids, labels = tree.ids[rows], tree.labels[rows]
            s = self._scored(q, tree.x[rows], tree.floats[rows], tree.longest)
            ok = self.counts(q, ids, labels, s)
            any_ = ok.any(1)
            q, s, ok = q[any_], s[any_], ok[any_]
            if len(q):
                score = np.concatenate([self.score[q], np.where(ok, s, NONE)], 1)
                found = np.concatenate([self.found[q], np.where(ok, ids, LAST)], 1)
                by = np.lexsort((found, -score), axis=-1)[:, : self.most]
                self.score[q], self.found[q] = np.take_along_axis(score, by, 1), np.take_along_axis(found, by, 1)
