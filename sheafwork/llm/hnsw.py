"""Hierarchical navigable small-world graphs in numpy, built and searched many points at a time.

After Malkov and Yashunin (2016). Points of a batch are inserted together: each searches the graph so far
and, by plain products, its own batch. Similarity is the inner product of unit rows in double precision.
"""

from __future__ import annotations

import numpy as np

#: Links a node (twice as many on the ground layer), and the beam while building.
LINKS, BUILD_BEAM = 12, 48
BATCH = 256
#: Nodes of a beam that one step opens.
OPENED = 4
#: Entries that a search takes from each upper layer.
ENTRIES = 8


class Graph:
    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.x = unit
        n = len(unit)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(LINKS)).astype(int), 5)
        self.order = np.argsort(-level, kind="stable")  # the top layers come first, so each layer is a prefix
        self.level = level
        self.links = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            new = self.order[done : done + max(1, min(BATCH, done))]
            self._insert(new, self.order[:done])
            done += len(new)
        if n:
            self._reach()

    def _insert(self, new: np.ndarray, there: np.ndarray) -> None:
        q = self.x[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        entry = None
        for k in range(len(self.links) - 1, -1, -1):
            on = self.level[new] >= k
            old_here = len(there) and self.level[there[0]] >= k
            if old_here:
                start = entry if entry is not None else np.full((len(new), 1), there[0])
                ids, sims = self.search_layer(q, start, BUILD_BEAM if on.any() else 1, k)
                entry = ids[:, :1]
            if not on.any():
                continue
            mates = np.where(on[None, :], own, -np.inf)
            some = min(BUILD_BEAM, len(new))
            near = np.argpartition(-mates, some - 1, axis=1)[:, :some]
            cand, sim = new[near], np.take_along_axis(mates, near, 1)
            if old_here:
                cand, sim = np.concatenate([ids, cand], 1), np.concatenate([sims, sim], 1)
            at = np.flatnonzero(on)
            chosen = self._diverse(cand[at], sim[at], self.links[k].shape[1])
            self.links[k][new[at], : chosen.shape[1]] = chosen
            self._back(new[at], chosen, k)

    def _reach(self) -> None:
        """Pruning may leave a node without a way in: its nearest reachable node gets a link to it."""
        ground, there = self.links[0], np.zeros(len(self.x), bool)
        front = np.array([self.order[0]])
        while len(front):
            there[front] = True
            near = np.unique(ground[front])
            front = near[(near >= 0) & ~there[np.maximum(near, 0)]]
        lost, known = np.flatnonzero(~there), np.flatnonzero(there)
        more: dict[int, list[int]] = {}
        for at in range(0, len(lost), BATCH):
            part = lost[at : at + BATCH]
            for u, v in zip(part, known[(self.x[part] @ self.x[known].T).argmax(1)], strict=True):
                more.setdefault(int(v), []).append(int(u))
        # So does a node whose ways in all come from much further off than its own nearest link.
        r, c = np.nonzero(ground >= 0)
        sim = np.einsum("nd,nd->n", self.x[r], self.x[ground[r, c]])
        into, best, near = np.full(len(self.x), -2.0), np.full(len(self.x), -2.0), np.full(len(self.x), -1)
        np.maximum.at(into, ground[r, c], sim)
        np.maximum.at(best, r, sim)
        first = sim >= best[r]
        near[r[first]] = ground[r, c][first]
        for u in np.flatnonzero((best > into + 0.001) & (near >= 0)):
            more.setdefault(int(near[u]), []).append(int(u))
        if more:
            extra = np.full((len(self.x), max(map(len, more.values()))), -1, np.int32)
            for v, us in more.items():
                extra[v, : len(us)] = us
            self.links[0] = np.concatenate([ground, extra], 1)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row the nearest, those first that no nearer one shadows; -1 where there are fewer."""
        some = min(2 * most, ids.shape[1])
        best = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, :some]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        good = (ids >= 0) & (sims > -np.inf)
        x = self.x[ids]
        between = np.einsum("rid,rjd->rij", x, x)
        # Shadowed: a nearer one is nearer to it than the node itself is.
        earlier = np.tril(np.ones((some, some), bool), -1)
        shadow = ((between >= sims[:, :, None]) & earlier & good[:, None, :]).any(2)
        first = np.argsort(np.where(good, shadow, 2), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(good, first, 1), np.take_along_axis(ids, first, 1), -1).astype(np.int32)

    def _back(self, new: np.ndarray, chosen: np.ndarray, k: int) -> None:
        """Links from the chosen to the new, all nodes at once; a full node chooses again."""
        r, c = np.nonzero(chosen >= 0)
        to, node = new[r], chosen[r, c]
        by = np.argsort(node, kind="stable")
        to, node = to[by], node[by]
        uniq, at, n = np.unique(node, return_index=True, return_counts=True)
        most = min(int(n.max(initial=0)), 4 * self.links[k].shape[1])
        place = np.arange(len(node)) - np.repeat(at, n)
        more = np.full((len(uniq), most), -1, np.int32)
        fits = place < most
        more[np.repeat(np.arange(len(uniq)), n)[fits], place[fits]] = to[fits]
        both = np.concatenate([self.links[k][uniq], more], 1)
        # Already linked ones would count twice.
        both[:, -most:][(more[:, :, None] == self.links[k][uniq][:, None, :]).any(2)] = -1
        sims = np.where(both >= 0, np.einsum("rmd,rd->rm", self.x[both], self.x[uniq]), -np.inf)
        self.links[k][uniq] = -1
        got = self._diverse(both, sims, self.links[k].shape[1])
        self.links[k][uniq, : got.shape[1]] = got

    def search_layer(self, q: np.ndarray, entry: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, -1 and -inf where a beam isn't full."""
        b, links, rows = len(q), self.links[k], np.arange(len(q))[:, None]
        seen = np.zeros((b, len(self.x)), bool)
        seen[rows, entry] = True
        ids, sims = entry.astype(np.int64), np.einsum("bmd,bd->bm", self.x[entry], q)
        sims[:, 1:][ids[:, 1:] == ids[:, :1]] = -np.inf
        open_ = sims > -np.inf
        while True:
            score = np.where(open_, sims, -np.inf)
            take = min(OPENED, score.shape[1])
            top = np.argpartition(-score, take - 1, axis=1)[:, :take]
            live = np.take_along_axis(score, top, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(open_, top, False, 1)
            near = links[np.take_along_axis(ids, top, 1)].reshape(b, -1)
            fresh = (near >= 0) & np.repeat(live, links.shape[1], 1) & ~seen[rows, near]
            near = np.where(fresh, near, -1)
            # Two opened nodes may share a neighbour: sort, and keep the first of each.
            near = -np.sort(-near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = -np.sort(-near, axis=1)
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            good = near >= 0
            seen[rows, np.where(good, near, ids[:, :1])] = True
            s = np.where(good, np.einsum("bmd,bd->bm", self.x[near], q), -np.inf)
            ids, sims, open_ = np.concatenate([ids, near], 1), np.concatenate([sims, s], 1), np.concatenate([open_, good], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, open_ = (np.take_along_axis(a, keep, 1) for a in (ids, sims, open_))
        best = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    @staticmethod
    def _whole(ids: np.ndarray) -> np.ndarray:
        """Entries without gaps: the best one stands in for what a beam lacks."""
        return np.where(ids >= 0, ids, ids[:, :1])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.order[0])
        for k in range(len(self.links) - 1, 0, -1):
            entry = self._whole(self.search_layer(q, entry, ENTRIES, k)[0])
        return self.search_layer(q, entry, min(beam, len(self.x)), 0)

    def within(self, q: np.ndarray, least: float, beam: int, slack: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """(rows of q, ids) of all found with similarity >= least.

        From the beam's nodes near enough, the ground layer is flooded as far as ``least - slack``, however
        many nodes that takes.
        """
        n = len(self.x)
        ids, sims = self.search(q, beam)
        seen = np.zeros(len(q) * n, bool)
        r, c = np.nonzero(sims >= least - slack)
        row, node, sim = r, ids[r, c], sims[r, c]
        seen[row * n + node] = True
        found = []
        while len(row):
            hit = sim >= least
            found.append((row[hit], node[hit]))
            near = self.links[0][node]
            rr, cc = np.nonzero(near >= 0)
            key = np.unique(row[rr] * n + near[rr, cc])
            key = key[~seen[key]]
            seen[key] = True
            row, node = key // n, key % n
            sim = np.concatenate([np.einsum("nd,nd->n", q[row[i : i + 65536]], self.x[node[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.empty(0)])
            far = sim >= least - slack
            row, node, sim = row[far], node[far], sim[far]
        return np.concatenate([f[0] for f in found] or [np.empty(0, int)]), np.concatenate([f[1] for f in found] or [np.empty(0, int)])
