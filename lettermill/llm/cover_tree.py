"""Cover trees over blocks of vectors, and dual-tree search for exact largest inner products.

A node has a centre, a covering radius (largest distance from the centre to a point below it), points that it holds
directly and children. Children's centres are further apart than the radius that covers their points, which shrinks by
``SHRINK`` a level. For a query node and a reference node with centres q, r and radii a, b no inner product of their
points exceeds q.r + |q| b + |r| a + a b; the pair is pruned if that is below every query's worst kept score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: A level's covering radius in terms of the one above; nodes of at most LEAF points hold them directly.
SHRINK, LEAF = 0.5, 32


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray
    held: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(vectors: np.ndarray, points: np.ndarray | None = None, radius: float | None = None) -> Node:
    """The cover tree over rows of ``vectors``."""
    points = np.arange(len(vectors)) if points is None else points
    centre = vectors[points[0]] if radius is not None else vectors[points].mean(axis=0)
    node = Node(centre, float(np.sqrt(((vectors[points] - centre) ** 2).sum(axis=1).max())), points, points)
    if len(points) <= LEAF or node.radius == 0:
        return node
    covering = SHRINK * node.radius
    left, single = points, []
    norms = (vectors**2).sum(axis=1)
    while len(left):
        first = left[0]
        squares = norms[left] + norms[first] - 2 * (vectors[left] @ vectors[first])
        near = squares <= covering * covering
        near[0] = True
        if near.sum() == 1:
            single.append(first)
        else:
            node.children.append(build(vectors, left[near], covering))
        left = left[~near]
    node.held = np.array(single, np.int64)
    return node


class Search:
    """The ``k`` best references of each query; ties go to the smaller id, and a query's own id doesn't count.

    ``worst`` are scores that references must reach to be of interest, known from elsewhere. Scores beyond a long are the
    nearest long.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.queries, self.ids, self.k = queries.astype(np.float64), query_ids, k
        self.whole = queries
        self.norms = np.sqrt((self.queries**2).sum(axis=1))
        self.scores = [np.empty(0, np.int64) for _ in query_ids]
        self.found = [np.empty(0, np.int64) for _ in query_ids]
        self.worst = np.full(len(query_ids), -np.inf) if worst is None else worst.astype(np.float64)
        vague = np.abs(self.worst) >= 2**53  # rounded, perhaps upwards
        self.worst[vague] = np.nextafter(self.worst[vague], -np.inf)
        self.root = build(self.queries) if len(query_ids) else None

    def add(self, references: np.ndarray, reference_ids: np.ndarray) -> None:
        """Search one more block of references."""
        self.against, self.against_ids, self.exact = references.astype(np.float64), reference_ids, references
        largest = float(np.abs(self.queries).max(initial=0)) * float(np.abs(self.against).max(initial=0)) * references.shape[1]
        self.safe = largest < 2**52  # then sums of products are exact in doubles
        if self.safe:
            self._pair(self.root, build(self.against))
        else:
            self._compare_all()

    def _compare_all(self) -> None:
        """Every pair in integers of any size, where doubles wouldn't be exact."""
        limits = np.iinfo(np.int64)
        for row, query in enumerate(self.whole.astype(object)):
            others = np.flatnonzero(self.against_ids != self.ids[row])
            scores = np.clip(self.exact[others].astype(object) @ query, limits.min, limits.max).astype(np.int64) if len(others) else np.empty(0, np.int64)
            self._merge(row, self.against_ids[others], scores)

    def _merge(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        found, value = np.r_[self.found[row], ids], np.r_[self.scores[row], scores]
        order = np.lexsort((found, ~value))[: self.k]
        self.found[row], self.scores[row] = found[order], value[order]
        if len(order) == self.k and abs(int(value[order[-1]])) < 2**53:
            self.worst[row] = max(self.worst[row], value[order[-1]])

    def _pair(self, q: Node, r: Node) -> None:
        slack = 1e-9 * (1 + np.linalg.norm(q.centre) * np.linalg.norm(r.centre))
        bound = q.centre @ r.centre + np.linalg.norm(q.centre) * r.radius + np.linalg.norm(r.centre) * q.radius + q.radius * r.radius + slack
        if bound < self.worst[q.points].min():
            return
        if len(r.held):
            open_ = q.points[self.queries[q.points] @ r.centre + self.norms[q.points] * r.radius + slack >= self.worst[q.points]]
            if len(open_):
                self._compare(open_, r.held)
        parts = q.children or [q]
        if q.children and len(q.held):
            parts = [*parts, Node(q.centre, q.radius, q.held, q.held)]
        bounds = [(float(p.centre @ c.centre), p, c) for c in r.children for p in parts]
        for _, p, c in sorted(bounds, key=lambda x: -x[0]):
            self._pair(p, c)

    def _compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        scores = self.queries[rows] @ self.against[columns].T
        own = self.ids[rows][:, None] == self.against_ids[columns][None, :]
        kept = (scores >= self.worst[rows][:, None]) & ~own
        if len(columns) > self.k:
            best = np.where(own, -np.inf, scores)
            kept &= best >= np.partition(best, -self.k, axis=1)[:, [-self.k]]
        for i in np.flatnonzero(kept.any(axis=1)):
            here = kept[i]
            self._merge(int(rows[i]), self.against_ids[columns[here]], scores[i][here].astype(np.int64))
