"""Cover trees over blocks of vectors, and a search that descends a tree of queries and a tree of data together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Query nodes of no more points than this are searched as one group.
GROUP = 16
#: Whole numbers up to here are exact as doubles, and so are their sums.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Share of a bound's own size that rounding may take.
ROUNDING = 1e-9


@dataclass
class CoverTree:
    """Points in the order of the tree's leaves. Node k covers the points lo[k] to hi[k], lo[k] being its own, within radius[k];
    its children are the count[k] nodes from first[k] on, the first of them with the same point. Leaves have one point."""

    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    def __post_init__(self):
        self.norm = distances(self.x, np.zeros(self.x.shape[1])) if len(self.x) else np.zeros(0)

    def children(self, nodes: np.ndarray) -> np.ndarray:
        n = self.count[nodes]
        return np.repeat(self.first[nodes] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(np.square(x - centre).sum(axis=1)), nan=np.inf)


def build(x: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """The tree of points x, and their order in it. A node's children lie within its radius, further than half of it from each
    other, and cover its points within that half; equal points are leaves below one node."""
    order = np.zeros(len(x), np.int64)
    lo, hi, first, count, radius = [0], [len(x)], [], [], []
    waiting = [(np.arange(len(x)), distances(x, x[0]))] if len(x) else []
    for at, (members, far) in enumerate(waiting):  # grows while it is read
        r = float(far.max())
        radius.append(r)
        first.append(len(lo))
        if len(members) == 1:
            order[lo[at]] = members[0]
            count.append(0)
            continue
        if r == 0 or not np.isfinite(r):
            parts = [(members[k : k + 1], np.zeros(1)) for k in range(len(members))]
        else:
            near = far <= r / 2
            parts, rest = [(members[near], far[near])], members[~near]
            while len(rest):
                away = distances(x[rest], x[rest[0]])
                near = away <= r / 2
                parts.append((rest[near], away[near]))
                rest = rest[~near]
        count.append(len(parts))
        start = lo[at]
        for part in parts:
            lo.append(start)
            start += len(part[0])
            hi.append(start)
        waiting += parts
        waiting[at] = None
    whole = lambda v: np.array(v[: len(radius)], np.int64)
    return CoverTree(x[order], whole(lo), whole(hi), whole(first), whole(count), np.array(radius)), order


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows of a with the row b, exactly, cut to 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        if len(a) and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
            return (a @ b).astype(np.int64)
    other = [int(v) for v in b]
    return np.array([max(LEAST, min(MOST, sum(int(v) * w for v, w in zip(row, other, strict=True)))) for row in a], np.int64)


class Search:
    """The k best rows of a data tree for each point of a query tree.

    floors: for each query a score that its kth best over all blocks reaches, LEAST if none is known. keys tell rows apart, so that
    a query leaves out its own; `ids` break ties, `no_id` marks null ones, which come last. `scored` counts node pairs.
    """

    def __init__(self, queries: CoverTree, data: CoverTree, floors: np.ndarray, query_keys: np.ndarray, keys: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int):
        self.q, self.d, self.k = queries, data, k
        self.query_keys, self.keys, self.ids, self.no_id = query_keys, keys, ids, no_id
        self.floors = floors.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floors]
        self.scored = 0
        self.exact = np.abs(queries.x).max(initial=0) * np.abs(data.x).max(initial=0) * max(1, data.x.shape[1]) < EXACT

    def run(self) -> Search:
        if not len(self.q.x) or not len(self.d.x):
            return self
        q, d = self.q, self.d
        waiting = [(0, np.zeros(1, np.int64))]
        while waiting:
            node, nodes = waiting.pop()
            own = slice(q.lo[node], q.hi[node])
            if q.hi[node] - q.lo[node] <= GROUP:
                self._group(own, nodes)
                continue
            # a pair of nodes goes where its best possible score is below the worst kth score of the query node
            nodes = nodes[self._bounds(q.x[own.start], q.norm[own.start], q.radius[node], nodes) >= self._floor(own).min()]
            larger = (d.radius[nodes] > q.radius[node]) & (d.count[nodes] > 0)
            nodes = np.concatenate((nodes[~larger], d.children(nodes[larger])))
            if len(nodes):
                waiting += [(child, nodes) for child in range(q.first[node], q.first[node] + q.count[node])]
        return self

    def _floor(self, own: slice) -> np.ndarray:
        """Floors as doubles, none above the true one; what was cut to LEAST may be less."""
        low = self.floors[own]
        return np.where(low == LEAST, -np.inf, np.nextafter(low.astype(float), -np.inf) if not self.exact else low.astype(float))

    def _bounds(self, centre: np.ndarray, norm: float, radius: float, nodes: np.ndarray) -> np.ndarray:
        """The greatest score that any point within `radius` of a query centre can have with any of each data node."""
        d, at = self.d, self.d.lo[nodes]
        self.scored += len(nodes)
        with np.errstate(over="ignore", invalid="ignore"):
            far = d.radius[nodes]
            top = d.x[at] @ centre + norm * far + radius * (d.norm[at] + far) + ROUNDING * (norm + radius) * (d.norm[at] + far)
        return np.nan_to_num(top, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def _group(self, own: slice, nodes: np.ndarray) -> None:
        q, d = self.q, self.d
        rows, norm = q.x[own], q.norm[own, None]
        while len(nodes):
            at = d.lo[nodes]
            self.scored += len(rows) * len(nodes)
            mine = self.query_keys[own, None] == self.keys[at]
            with np.errstate(over="ignore", invalid="ignore"):
                score = rows @ d.x[at].T
                slack = 0 if self.exact else ROUNDING * norm * d.norm[at]
                top = np.nan_to_num(score + norm * d.radius[nodes] * (1 + ROUNDING) + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            if self.exact and len(nodes) >= self.k:  # nodes' own points are rows that differ, so the kth of them is a floor
                low = np.partition(np.where(mine, -np.inf, score), len(nodes) - self.k, axis=1)[:, len(nodes) - self.k]
                self.floors[own] = np.maximum(self.floors[own], np.where(np.isfinite(low), low, LEAST).astype(np.int64))
            alive = top >= self._floor(own)[:, None]
            leaf = d.count[nodes] == 0
            for k in np.flatnonzero((alive & leaf & ~mine).any(axis=1)):
                some = at[alive[k] & leaf & ~mine[k]]
                self._add(own.start + int(k), some, products(d.x[some], rows[k]))
            nodes = d.children(nodes[~leaf & alive.any(axis=0)])

    def _add(self, query: int, points: np.ndarray, scores: np.ndarray) -> None:
        held = self.best[query]
        points, scores = np.append(held[0], points), np.append(held[1], scores)
        order = np.lexsort((self.ids[points], self.no_id[points], ~scores))[: self.k]
        self.best[query] = points[order], scores[order]
        if len(order) == self.k:
            self.floors[query] = max(self.floors[query], scores[order[-1]])
