"""Hierarchical navigable small-world graphs (Malkov and Yashunin, 2016), searched many queries at a time."""

from __future__ import annotations

import functools
import pickle

import numpy as np

LINKS, BUILD_BEAM, BATCH = 12, 40, 256
#: Nodes near a query that are walked to; beyond, the query is left to a product with all nodes.
CROWD = 512


def _similarities(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Dot products of each query with its own list of nodes."""
    return np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities of the ``beam`` best nodes found for each query; all queries step together."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, beam), -1, dtype=np.int64)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, len(x) + 1), dtype=bool)  # the last column is for padding
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, _similarities(x, q, entry[:, None])[:, 0], True
    seen[rows, entry] = True
    while True:
        ranked = np.where(open_, sims, -np.inf)
        best = ranked.argmax(axis=1)
        active = np.flatnonzero(open_[rows, best])
        if not len(active):
            return ids, sims
        best = best[active]
        open_[active, best] = False
        near = links[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        got = np.where(fresh, _similarities(x, q[active], near), -np.inf)
        all_sims = np.concatenate((sims[active], got), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), top, axis=1)
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), axis=1), top, axis=1)
        ids[active] = np.where(np.isneginf(sims[active]), -1, ids[active])


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """From candidates of each row (best first, -1: none), those nearer to the row's node than to any chosen before."""
    n = len(ids)
    chosen = np.full((n, most), -1, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    for k in range(ids.shape[1]):
        c = ids[:, k]
        able = (c >= 0) & (count < most)
        if not able.any():
            continue
        to_chosen = np.where(chosen[able] >= 0, _similarities(x, x[c[able]], chosen[able]), -np.inf).max(axis=1)
        take = np.flatnonzero(able)[to_chosen <= sims[able, k]]
        chosen[take, count[take]] = c[take]
        count[take] += 1
    return chosen


def _connect(x: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Link new nodes to diverse candidates, and the candidates back; lists that overflow are thinned."""
    order = np.argsort(-sims, axis=1, kind="stable")
    chosen = _diverse(x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), LINKS)
    links[new, :LINKS] = chosen
    u, v = np.repeat(new, LINKS), chosen.ravel()
    u, v = u[v >= 0], v[v >= 0]
    by = np.lexsort((-np.einsum("ij,ij->i", x[u], x[v]), v))
    u, v = u[by], v[by]
    targets, start, count = np.unique(v, return_index=True, return_counts=True)
    wide = int(min(count.max(initial=0), 2 * links.shape[1]))
    if not wide:
        return
    slot = start[:, None] + np.minimum(np.arange(wide), count[:, None] - 1)
    added = np.where(np.arange(wide) < count[:, None], u[slot], -1)
    merged = np.concatenate((links[targets], added), axis=1)
    merged[merged == targets[:, None]] = -1
    sim = np.where(merged >= 0, _similarities(x, x[targets], merged), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    merged, sim = np.take_along_axis(merged, order, axis=1), np.take_along_axis(sim, order, axis=1)
    merged[:, 1:][(merged[:, 1:] == merged[:, :-1])] = -1
    full = (merged >= 0).sum(axis=1) > links.shape[1]
    kept = merged[:, : links.shape[1]].copy()
    for i in np.flatnonzero(~full):
        row = merged[i][merged[i] >= 0]
        kept[i, : len(row)], kept[i, len(row) :] = row, -1
    if full.any():
        kept[full] = _diverse(x, merged[full], sim[full], links.shape[1])
    links[targets] = kept


class Graph:
    """A graph over unit vectors; nodes are row numbers, in the order given."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        height = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 6)
        #: From the top: the nodes of each level and their links, as positions within the level.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(0, dtype=np.int64)
        for level in range(int(height.max(initial=0)), -1, -1):
            rest = rng.permutation(np.flatnonzero((height >= level) & ~np.isin(np.arange(n), above)))
            nodes = np.concatenate((above, rest))
            if len(nodes):
                self.levels.append((nodes, self._level(nodes, len(above))))
            above = nodes

    def _level(self, nodes: np.ndarray, old: int) -> np.ndarray:
        x = self.x[nodes]
        links = np.full((len(nodes), 2 * LINKS), -1, dtype=np.int64)
        if old:  # nodes of the level above come first, in its order, and start with its links
            links[:old] = self.levels[-1][1]
        done = max(old, 1)
        while done < len(nodes):
            new = np.arange(done, min(len(nodes), done + min(BATCH, max(8, done // 2))))
            entry = self._enter(x[new]) if self.levels else np.zeros(len(new), dtype=np.int64)
            ids, sims = beam_search(x[:done], links[:done], x[new], entry, min(BUILD_BEAM, max(8, done)))
            own = x[new] @ x[new].T  # nodes of one batch see each other as well
            np.fill_diagonal(own, -np.inf)
            k = min(LINKS, len(new) - 1)
            if k:
                near = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate((ids, new[near]), axis=1)
                sims = np.concatenate((sims, np.take_along_axis(own, near, axis=1)), axis=1)
            _connect(x, links, new, ids, sims)
            done = int(new[-1]) + 1
        return links

    def _enter(self, q: np.ndarray, down_to: int | None = None) -> np.ndarray:
        """The position in the next level's order of the node nearest to each query, from the top."""
        entry = np.zeros(len(q), dtype=np.int64)
        for nodes, links in self.levels if down_to is None else self.levels[:down_to]:
            ids, sims = beam_search(self.x[nodes], links, q, entry, 4)
            entry = ids[np.arange(len(q)), sims.argmax(axis=1)]
        return entry

    @functools.cached_property
    def _pointing(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the lowest level by the node they link to, and where each one's list starts."""
        links = self.levels[-1][1]
        able = links.ravel() >= 0
        to, by = links.ravel()[able], np.flatnonzero(able) // links.shape[1]
        order = np.argsort(to, kind="stable")
        return by[order], np.searchsorted(to[order], np.arange(len(links) + 1))

    def within(self, q: np.ndarray, least: float, beam: int, crowd: int = CROWD) -> list[np.ndarray | None]:
        """For each query the nodes found with a similarity of ``least`` or more.

        A beam search finds the surroundings; from what is near enough there, links are followed for
        as long as they stay near enough.  A query whose whole beam, or more than ``crowd`` nodes, are
        near enough gets None: comparing it with all nodes by a product is cheaper than the walk.
        """
        nodes, links = self.levels[-1]
        x = self.x[nodes]
        # Links are followed both ways: a node that others' thinned lists left out is still reached.
        sources, start = self._pointing
        out: list[np.ndarray | None] = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            ids, sims = beam_search(x, links, part, self._enter(part, len(self.levels) - 1), beam)
            for row, (i, s) in enumerate(zip(ids, sims, strict=True)):
                if (s >= least).all():
                    out.append(None)
                    continue
                edge = i[s >= least - 0.02]
                hits = [i[s >= least]]
                many = len(hits[0])
                seen = set(i[i >= 0].tolist())
                while len(edge) and many <= crowd:
                    near = np.unique(np.concatenate([links[edge].ravel(), *(sources[start[e] : start[e + 1]] for e in edge.tolist())]))
                    near = np.array([v for v in near.tolist() if v >= 0 and v not in seen], dtype=np.int64)
                    if not len(near):
                        break
                    seen.update(near.tolist())
                    found = x[near] @ part[row]
                    hits.append(near[found >= least])
                    many += len(hits[-1])
                    edge = near[found >= least - 0.02]
                out.append(nodes[np.concatenate(hits)] if many <= crowd else None)
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.x, [(a.astype(np.int32), b.astype(np.int32)) for a, b in self.levels]))

    @classmethod
    def load(cls, blob: bytes) -> Graph:
        out = cls.__new__(cls)
        out.x, out.levels = pickle.loads(blob)
        return out
