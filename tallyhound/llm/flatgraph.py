"""A robust-pruned neighbour graph over unit vectors, in numpy: candidates from tiles of cosines, beam search in lockstep, range expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class FlatGraph:
    """``x``: unit vectors (float32 rows). ``near``: up to ``degree`` neighbours of each row, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 16, alpha: float = 1.2) -> None:
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, np.float32(alpha)
        self.near = np.full((len(x), degree), -1, np.int32)
        self.medoid = int(np.argmax(x @ x.mean(0))) if len(x) else 0

    def build(self, seed: int = 7, tile: int = 512) -> FlatGraph:
        """Prunes each row's candidates: its nearest rows, from the cosines of a tile of rows with all, and a few at random, so that the graph reaches from one cluster
        to the next. A graph holds a shard, so this costs less than inserting row by row, and no near row is missed."""
        n, rng = len(self.x), np.random.default_rng(seed)
        near = min(n - 1, 5 * self.degree // 3)
        for at in range(0, n if near > 0 else 0, tile):
            rows = np.arange(at, min(n, at + tile))
            sims = self.x[rows] @ self.x.T
            sims[np.arange(len(rows)), rows] = -np.inf
            pool = np.argpartition(sims, n - near, axis=1)[:, n - near :]
            self.near[rows] = self.prune(rows, np.hstack((pool, rng.integers(0, n, (len(rows), self.degree // 2)))).astype(np.int32))
        for at in range(0, n, 4096):
            rows = np.arange(at, min(n, at + 4096))
            self._link_back(rows, self.near[rows].copy())
        return self

    def prune(self, rows: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and removes those that are ``alpha`` times nearer to it than to the row.

        Slots that stay empty take the nearest of the removed; else the members of a tight group would hang on its centre alone, whose
        own slots are soon full.
        """
        pool = np.where(pool == rows[:, None], -1, pool)
        c = self.x[pool]
        own = self.x[rows]
        far = 1 - np.matmul(c, own[:, :, None])[:, :, 0]  # half the squared distance
        far[pool < 0] = np.inf
        spare = far.copy()
        out = np.full((len(rows), self.degree), -1, np.int32)
        i = np.arange(len(rows))
        for k in range(self.degree):
            best = np.argmin(far, axis=1)
            good = np.isfinite(far[i, best])
            if not good.any():
                break
            out[good, k] = pool[i, best][good]
            s = c[i, best]
            between = 1 - np.matmul(c, s[:, :, None])[:, :, 0]
            far[(self.alpha**2) * between <= far] = np.inf
            far[i, best] = np.inf
            spare[i[good], best[good]] = np.inf
        used = (out >= 0).sum(1)
        order = np.argsort(spare, axis=1, kind="stable")[:, : self.degree]
        rest = np.where(np.isfinite(np.take_along_axis(spare, order, 1)), np.take_along_axis(pool, order, 1), -1)
        fill = np.arange(self.degree) - used[:, None]
        take = (fill >= 0) & (fill < rest.shape[1])
        return np.where(take, np.take_along_axis(rest, np.clip(fill, 0, rest.shape[1] - 1), 1), out).astype(np.int32)

    def _link_back(self, rows: np.ndarray, chosen: np.ndarray) -> None:
        have = chosen >= 0
        to, source = chosen[have], np.repeat(rows, chosen.shape[1]).reshape(chosen.shape)[have]
        sim = np.einsum("ij,ij->i", self.x[to], self.x[source])
        order = np.lexsort((-sim, to))
        to, source = to[order], source[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        nth = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        keep = nth < 2 * self.degree  # the nearest newcomers
        to, source, nth = to[keep], source[keep], nth[keep]
        nodes, which = np.unique(to, return_inverse=True)
        pool = np.full((len(nodes), 3 * self.degree), -1, np.int32)
        pool[:, : self.degree] = self.near[nodes]
        pool[which, self.degree + nth] = source
        full = (pool >= 0).sum(1) > self.degree
        packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), 1)
        self.near[nodes[~full]] = packed[~full, : self.degree]
        if full.any():
            self.near[nodes[full]] = self.prune(nodes[full], pool[full])

    def search(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of all queries from the medoid and from their ``own`` rows: the rows found (-1: none) and their cosines, unsorted."""
        b, width = len(queries), self.beam
        ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
        done = np.zeros((b, width), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0], sims[:, 0] = self.medoid, queries @ self.x[self.medoid]
        ids[:, 1], sims[:, 1] = own, np.einsum("ij,ij->i", queries, self.x[own])
        sims[own == self.medoid, 1] = -np.inf
        seen[:, self.medoid] = True
        seen[np.arange(b), own] = True
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            best = np.argmax(open_sims, axis=1)
            more = np.isfinite(open_sims[np.arange(len(live)), best])
            live, best = live[more], best[more]
            if not len(live):
                break
            node = ids[live, best]
            done[live, best] = True
            to = self.near[node]
            s = np.matmul(self.x[to], queries[live][:, :, None])[:, :, 0]
            s[(to < 0) | seen[live[:, None], to]] = -np.inf
            r, k = np.nonzero(to >= 0)
            seen[live[r], to[r, k]] = True
            all_ids, all_sims = np.hstack((ids[live], to)), np.hstack((sims[live], s))
            all_done = np.hstack((done[live], np.zeros_like(to, bool)))
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, top, 1)
            ids[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(all_ids, top, 1), -1)
            done[live] = np.take_along_axis(all_done, top, 1)
        return ids, sims

    def within(self, cosine: float, slack: float = 0.02, batch: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For batch after batch of rows: pairs of a row and another found with at least about ``cosine``. Every row is searched for from the
        medoid and itself, then the search spreads over all neighbours of rows in range (``slack`` wider) until none is new."""
        n = len(self.x)
        for at in range(0, n, batch):
            q = np.arange(at, min(n, at + batch))
            ids, sims = self.search(self.x[q], q)
            r, k = np.nonzero((sims >= cosine - slack) & (ids >= 0))
            front_q, front_n = r, ids[r, k].astype(np.int64)
            seen = np.zeros((len(q), n), bool)  # anew: the beam has dropped rows in range that it compared
            hit = np.zeros((len(q), n), bool)
            seen[front_q, front_n] = hit[front_q, front_n] = True
            while len(front_q):
                next_q, next_n = [], []
                for part in range(0, len(front_q), 20_000):
                    fq = np.repeat(front_q[part : part + 20_000], self.near.shape[1])
                    fn = self.near[front_n[part : part + 20_000]].ravel()
                    new = np.flatnonzero(fn >= 0)
                    new = new[~seen[fq[new], fn[new]]]
                    pair = np.unique(fq[new] * n + fn[new])
                    fq, fn = pair // n, pair % n
                    seen[fq, fn] = True
                    near = np.einsum("ij,ij->i", self.x[q[fq]], self.x[fn]) >= cosine - slack
                    hit[fq[near], fn[near]] = True
                    next_q.append(fq[near])
                    next_n.append(fn[near])
                front_q, front_n = np.concatenate(next_q), np.concatenate(next_n)
            hit[np.arange(len(q)), q] = False
            r, other = np.nonzero(hit)
            if len(r):
                yield q[r], other
