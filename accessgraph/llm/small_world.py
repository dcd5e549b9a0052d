"""A hierarchical navigable small-world graph over one shard of unit vectors.

Searches and insertions run for a block of vectors at a time, so that every
step is one array operation and not one per vector.
"""

from __future__ import annotations

import io
import math

import numpy as np

LINKS, BASE_LINKS = 16, 32
BUILD_BEAM = 64
BLOCK = 256


def _row_unique(ids: np.ndarray) -> np.ndarray:
    """Sort each row and set repeated ids to -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most similar entries of each row, best first."""
    k = min(k, ids.shape[1])
    if k < ids.shape[1]:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class SmallWorld:
    """Graph over ``vectors`` (unit length, 32 bits); ``draws`` in (0, 1) choose the levels."""

    def __init__(self, vectors: np.ndarray, draws: np.ndarray | None = None, links: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.entry = entry
        if links is not None:
            self.links = links
            return
        n = len(vectors)
        levels = np.minimum(np.floor(-np.log(draws) / math.log(LINKS)), 8).astype(np.int64)
        order = np.argsort(-levels, kind="stable")
        self.links = [np.full((n, LINKS if i else BASE_LINKS), -1, np.int32) for i in range(int(levels.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else 0
        done = 0
        while done < n:
            size = min(max(16, done), BLOCK, n - done)
            self._insert(order[done : done + size], levels, done > 0)
            done += size

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"links{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, vectors: np.ndarray, saved: bytes) -> SmallWorld:
        with np.load(io.BytesIO(saved)) as parts:
            links = [parts[f"links{i}"] for i in range(len(parts.files) - 1)]
            return cls(vectors, links=links, entry=int(parts["entry"]))

    def _sims(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        sims = np.matmul(self.vectors[ids], queries[:, :, None])[:, :, 0]
        sims[ids < 0] = -np.inf
        return sims

    def _search_layer(self, queries: np.ndarray, starts: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once; ``starts`` holds entry ids per query, -1 for none."""
        links, rows = self.links[layer], np.arange(len(queries))[:, None]
        ids = _row_unique(starts)
        sims = self._sims(queries, ids)
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)
        seen[:, -1] = True
        seen[rows, ids] = True
        ids, sims = _best(ids, sims, beam)
        opened = ids < 0
        width = max(4, beam // 16)
        while True:
            waiting = np.where(opened, -np.inf, sims)
            pick = np.argsort(-waiting, axis=1, kind="stable")[:, :width]
            fresh = np.take_along_axis(waiting, pick, 1) > -np.inf
            active = np.flatnonzero(fresh.any(axis=1))
            if not len(active):
                return ids, sims
            pick, fresh = pick[active], fresh[active]
            chosen = np.where(fresh, ids[active[:, None], pick], -1)
            opened[active[:, None], pick] = True
            nearby = np.where((chosen >= 0)[:, :, None], links[chosen], -1).reshape(len(active), -1)
            nearby[seen[active[:, None], nearby]] = -1
            nearby = _row_unique(nearby)
            seen[active[:, None], nearby] = True
            found = self._sims(queries[active], nearby)
            all_ids = np.concatenate([ids[active], nearby], axis=1)
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_open = np.concatenate([opened[active], nearby < 0], axis=1)
            if ids.shape[1] < beam:
                grow = min(beam, all_ids.shape[1]) - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)), constant_values=True)
            keep = ids.shape[1]
            part = np.argpartition(-all_sims, keep - 1, axis=1)[:, :keep] if keep < all_ids.shape[1] else np.arange(keep)[None]
            ids[active] = np.take_along_axis(all_ids, part, 1)
            sims[active] = np.take_along_axis(all_sims, part, 1)
            opened[active] = np.take_along_axis(all_open, part, 1)

    def _descend(self, queries: np.ndarray, to_layer: int) -> np.ndarray:
        starts = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, to_layer, -1):
            starts = self._search_layer(queries, starts, layer, 4)[0]
        return starts

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the ``beam`` nearest vectors of each query, -1 where there are fewer."""
        return self._search_layer(queries, self._descend(queries, 0), 0, beam)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """``m`` links per row: those nearer to the row's vector than to a link already taken, then the nearest rest."""
        ids, sims = _best(ids, sims, BUILD_BEAM)
        near = self.vectors[ids]
        between = np.matmul(near, near.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            hidden = (taken & (between[:, k, :] > sims[:, k, None])).any(axis=1)
            taken[:, k] = (ids[:, k] >= 0) & ~hidden & (taken.sum(axis=1) < m)
        rank = np.where(taken, sims + 4, np.where(ids >= 0, sims, -np.inf))
        out = _best(np.where(rank > -np.inf, ids, -1), rank, m)[0]
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _insert(self, block: np.ndarray, levels: np.ndarray, linked: bool) -> None:
        queries = self.vectors[block]
        mates = queries @ queries.T
        np.fill_diagonal(mates, -np.inf)
        starts = np.full((len(block), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            if linked:
                found, sims = self._search_layer(queries, starts, layer, BUILD_BEAM if layer == 0 or (levels[block] >= layer).any() else 4)
                starts = found[:, :4]
            own = np.flatnonzero(levels[block] >= layer)
            if not len(own):
                continue
            near = _best(np.tile(block[own], (len(own), 1)), mates[np.ix_(own, own)], BUILD_BEAM)
            near = np.where(near[1] > -np.inf, near[0], -1), near[1]
            if linked:
                near = tuple(np.concatenate(x, axis=1) for x in zip(near, (found[own], sims[own]), strict=True))
            width = self.links[layer].shape[1]
            chosen = self._spread(near[0], near[1], width)
            self.links[layer][block[own]] = chosen
            self._link_back(np.repeat(block[own], width), chosen.ravel(), layer)

    def _link_back(self, new: np.ndarray, old: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        real = old >= 0
        new, old = new[real], old[real]
        if not len(new):
            return
        sims = np.einsum("ij,ij->i", self.vectors[new], self.vectors[old])
        order = np.lexsort((-sims, old))
        new, old = new[order], old[order]
        first = np.r_[True, old[1:] != old[:-1]]
        rank = np.arange(len(old)) - np.maximum.accumulate(np.where(first, np.arange(len(old)), 0))
        nodes, row = old[first], np.cumsum(first) - 1
        some = rank < BUILD_BEAM - BASE_LINKS
        extra = np.full((len(nodes), BUILD_BEAM - BASE_LINKS), -1, np.int64)
        extra[row[some], rank[some]] = new[some]
        for at in range(0, len(nodes), 512):
            these = nodes[at : at + 512]
            ids = _row_unique(np.concatenate([links[these], extra[at : at + 512]], axis=1))
            ids[ids == these[:, None]] = -1
            links[these] = self._spread(ids, self._sims(self.vectors[these], ids), links.shape[1])
