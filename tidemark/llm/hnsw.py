"""A hierarchical navigable small-world graph in numpy, for many insertions and queries at a time.

Every point is in layer 0 and, with falling odds, in layers above it. Points are inserted in batches, each point
linked to near points that aren't nearer to one another than to it, so that clusters stay connected. Queries walk
the graph side by side: each step takes the best point of each query's beam that hasn't been opened yet.
"""

from __future__ import annotations

import numpy as np

LINKS, BEAM, BATCH, SEED = 16, 48, 256, 7


class Graph:
    """Over unit vectors in float32; near means a large dot product."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.points, self.layers, self.entry = points, layers or [], entry

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        n = len(points)
        level = np.minimum((-np.log(np.random.default_rng(SEED).random(n)) / np.log(LINKS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the highest first, so that the entry point never changes
        self = cls(points, [np.full((n, LINKS * 2 if layer == 0 else LINKS), -1, np.int32) for layer in range(level.max(initial=0) + 1)], int(order[0]) if n else 0)
        at = 1
        while at < n:
            batch = order[at : at + min(BATCH, max(1, at))]
            at += len(batch)
            q, start = points[batch], np.full((len(batch), 1), self.entry)
            for layer in reversed(range(len(self.layers))):
                own = level[batch] >= layer
                ids, sims = self._walk(q, start, BEAM if own.any() else 1, layer)
                start = ids[:, :1]
                if own.any():
                    self._link(batch[own], ids[own], sims[own], layer)
        return self

    def _walk(self, q: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest points found for each query, nearest first; -1 where there are fewer."""
        links, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.points)), bool)
        np.put_along_axis(seen, start, True, axis=1)
        ids = np.full((len(q), max(beam, start.shape[1])), -1, np.int64)
        sims = np.full(ids.shape, -2.0, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("bkd,bd->bk", self.points[start], q)
        opened = ids < 0
        alive = rows
        while len(alive):
            best = np.where(opened[alive], -3.0, sims[alive]).argmax(axis=1)
            more = ~opened[alive, best]
            alive, best = alive[more], best[more]
            if not len(alive):
                break
            opened[alive, best] = True
            next_ = links[ids[alive, best]].astype(np.int64)
            new = (next_ >= 0) & ~seen[alive[:, None], next_]
            some = new.any(axis=1)
            if not some.any():
                continue
            lanes, next_, new = alive[some], next_[some], new[some]
            seen[lanes[:, None], np.where(new, next_, next_.max(axis=1, keepdims=True))] = True
            near = np.where(new, np.einsum("bkd,bd->bk", self.points[next_], q[lanes]), -2.0)
            all_ids = np.hstack([ids[lanes], np.where(new, next_, -1)])
            all_sims = np.hstack([sims[lanes], near])
            all_opened = np.hstack([opened[lanes], ~new])
            top = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[lanes], sims[lanes], opened[lanes] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_opened))
        order = np.argsort(-sims, axis=1)[:, :beam]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, size: int) -> np.ndarray:
        """Of each row's candidates, nearest first: those not nearer to a chosen one than to the row's point, then the nearest of the rest."""
        chosen = np.zeros(ids.shape, bool)
        pts = self.points[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", pts, pts)
        for j in range(ids.shape[1]):
            near = np.where(chosen, between[:, j], -2.0).max(axis=1)
            chosen[:, j] = (ids[:, j] >= 0) & (near <= sims[:, j]) & (chosen.sum(axis=1) < size)
        order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :size]
        return np.take_along_axis(ids, order, axis=1)

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        # The points of one batch don't find each other in the graph.
        among = self.points[new] @ self.points[new].T
        np.fill_diagonal(among, -2.0)
        k = min(8, len(new) - 1)
        if k > 0:
            top = np.argpartition(-among, k - 1, axis=1)[:, :k]
            ids = np.hstack([ids, new[top]])
            sims = np.hstack([sims, np.take_along_axis(among, top, axis=1)])
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = self._choose(ids, sims, LINKS)
        links[new, : out.shape[1]] = out
        # And back: each point that is linked to gets the new ones, and chooses anew when it has too many.
        to, frm = out.ravel(), np.repeat(new, out.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        hit, first, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max())
        back = np.full((len(hit), width), -1, np.int64)
        back[np.repeat(np.arange(len(hit)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        for i in range(0, len(hit), BATCH):
            h = hit[i : i + BATCH]
            have = np.hstack([links[h].astype(np.int64), back[i : i + BATCH]])
            have.sort(axis=1)
            have[:, 1:][have[:, 1:] == have[:, :-1]] = -1
            near = np.where(have >= 0, np.einsum("bkd,bd->bk", self.points[np.maximum(have, 0)], self.points[h]), -2.0)
            order = np.argsort(-near, axis=1, kind="stable")
            have, near = np.take_along_axis(have, order, axis=1), np.take_along_axis(near, order, axis=1)
            used = int((have >= 0).sum(axis=1).max())
            kept = self._choose(have[:, :used], near[:, :used], links.shape[1]) if used > links.shape[1] else have[:, : links.shape[1]]
            links[h, : kept.shape[1]] = kept

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for layer in reversed(range(1, len(self.layers))):
            start = self._walk(q, start, 1, layer)[0]
        return self._walk(q, start, beam, 0)
