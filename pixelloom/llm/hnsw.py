"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many queries at once in numpy.

A graph holds vectors in the order they were inserted; layer l has the first n / degree^l of them, so that upper layers are
samples of the lower. Each layer is built by inserting batches: a batch searches what is there, compares its members with each
other, keeps for each the nearest neighbours that are not nearer to one another, and links back. At the end every vector is
searched for: those that are not found are linked from what was found instead, until all are. A beam as wide as the graph is a
scan of it.
"""

from __future__ import annotations

import numpy as np

#: Links of a vector in upper layers; twice as many in the lowest.
DEGREE = 16
#: Beam while a graph is built.
BUILD_BEAM = 64
#: Queries that are searched side by side.
SIDE_BY_SIDE = 256
#: Open vectors of a beam that are expanded at once.
WIDTH = 4


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither overflow nor vanish."""
    out = np.asarray(vectors, np.float64)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates ids (-1: none), at most `most` a row: those nearer to the row than to one chosen before, then the nearest."""
    by = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
    valid = ids >= 0
    near = x[np.maximum(ids, 0)]
    between = np.matmul(near, near.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        hidden = (chosen & (between[:, c, :] > sims[:, c, None])).any(1)
        chosen[:, c] = valid[:, c] & ~hidden & (chosen.sum(1) < most)
    rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(valid, ids, -1), rank, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best `width` vectors that a walk over links reaches from start (a row of ids a query); -1: none."""
    n = len(queries)
    seen = np.zeros((n, len(x)), bool)
    width = max(width, start.shape[1])
    ids, sims, fresh = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
    k = start.shape[1]
    ids[:, :k], fresh[:, :k] = start, True
    sims[:, :k] = np.einsum("qkd,qd->qk", x[start], queries)
    seen[np.arange(n)[:, None], start] = True
    rows = np.arange(n)
    while len(rows):
        score = np.where(fresh[rows], sims[rows], -np.inf)
        pick = np.argpartition(-score, min(WIDTH, width) - 1, axis=1)[:, :WIDTH]
        usable = np.take_along_axis(score, pick, 1) > -np.inf
        more = usable.any(1)
        rows, pick, usable = rows[more], pick[more], usable[more]
        if not len(rows):
            break
        near = links[np.take_along_axis(ids[rows], pick, 1)]
        near[~usable] = -1
        opened = fresh[rows]
        np.put_along_axis(opened, pick, False, 1)
        near = np.sort(near.reshape(len(rows), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows[:, None], near]] = -1  # -1 reads the last vector: those are -1 already or are set to -1
        near = np.sort(near, axis=1)[:, near.shape[1] - max(1, int((near >= 0).sum(1).max())) :]
        there = near >= 0
        seen[np.broadcast_to(rows[:, None], near.shape)[there], near[there]] = True
        found = np.einsum("qkd,qd->qk", x[np.maximum(near, 0)], queries[rows])
        found[~there] = -np.inf
        all_ids, all_sims = np.concatenate([ids[rows], near], 1), np.concatenate([sims[rows], found], 1)
        all_fresh = np.concatenate([opened, there], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[rows], sims[rows], fresh[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_fresh))
    return ids, sims


class Graph:
    """Layers of links, lowest first, over unit vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x = vectors.astype(np.float32)
        self.layers: list[np.ndarray] = layers or []
        if layers is None and len(vectors):
            sizes = [len(vectors)]
            while sizes[-1] > 2 * DEGREE:
                sizes.append(-(-sizes[-1] // DEGREE))
            above: list[np.ndarray] = []
            for level in range(len(sizes) - 1, -1, -1):
                above.insert(0, self._layer(sizes[level], DEGREE * (1 if level else 2), above))
            self.layers = above
            self._found()

    def _start(self, queries: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """The best vector of the lowest of layers for each query, from the top down."""
        at = np.zeros((len(queries), 1), np.int32)
        for links in reversed(layers):
            ids, sims = _beam(self.x[: len(links)], links, queries, at, WIDTH)
            at = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)
        return at

    def _layer(self, size: int, degree: int, above: list[np.ndarray]) -> np.ndarray:
        links = np.full((size, degree), -1, np.int32)
        done = 0
        while done < size:
            take = min(size - done, max(done, DEGREE), SIDE_BY_SIDE)
            q, new = self.x[done : done + take], np.arange(done, done + take, dtype=np.int32)
            own = q @ q.T
            earlier = np.tri(take, k=-1, dtype=bool)
            ids, sims = np.where(earlier, new[None, :], -1), np.where(earlier, own, -np.inf)
            if done:
                start = self._start(q, above) if above and len(above[0]) <= done else np.zeros((take, 1), np.int32)
                found = _beam(self.x[:done], links, q, start, BUILD_BEAM)
                ids, sims = np.concatenate([found[0], ids], 1), np.concatenate([found[1], sims], 1)
            if ids.shape[1] > BUILD_BEAM:
                top = np.argpartition(-sims, BUILD_BEAM - 1, axis=1)[:, :BUILD_BEAM]
                ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            links[new, :DEGREE] = _diverse(self.x, ids, sims, DEGREE)
            self._back(links, new)
            done += take
        return links

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Link the neighbours of new vectors back to them; full rows keep the most diverse."""
        degree = links.shape[1]
        to = links[new, :DEGREE].astype(np.int64)
        source = np.broadcast_to(new[:, None], to.shape)[to >= 0]
        to = to[to >= 0]
        if not len(to):
            return
        sims = np.einsum("kd,kd->k", self.x[to], self.x[source])
        by = np.lexsort((-sims, to))
        to, source = to[by], source[by]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        fits = place < 2 * degree
        extra = np.full((len(targets), min(int(count.max()), 2 * degree)), -1, np.int32)
        extra[np.repeat(np.arange(len(targets)), count)[fits], place[fits]] = source[fits]
        for lo in range(0, len(targets), SIDE_BY_SIDE):
            t = targets[lo : lo + SIDE_BY_SIDE]
            ids = np.sort(np.concatenate([links[t], extra[lo : lo + SIDE_BY_SIDE]], 1), axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == t[:, None]] = -1
            near = np.einsum("qkd,qd->qk", self.x[np.maximum(ids, 0)], self.x[t])
            near[ids < 0] = -np.inf
            links[t] = _diverse(self.x, ids, near, degree)

    def _found(self, rounds: int = 8) -> None:
        """Extra links in the lowest layer, so that a search for a vector of the graph finds it."""
        rows = np.arange(len(self.x))
        for _ in range(rounds):
            ids, sims = self.search(self.x[rows], DEGREE)
            own = np.einsum("kd,kd->k", self.x[rows], self.x[rows])
            lost = (ids != rows[:, None]).all(1) & (sims.max(1) < own - 1e-6)
            rows = rows[lost]
            if not len(rows):
                break
            source = np.take_along_axis(ids[lost], np.argsort(-sims[lost], axis=1)[:, :4], 1)
            to = np.broadcast_to(rows[:, None], source.shape)[source >= 0]
            source = source[source >= 0]
            by = np.argsort(source, kind="stable")
            source, to = source[by], to[by]
            _, first, count = np.unique(source, return_index=True, return_counts=True)
            extra = np.full((len(self.x), int(count.max())), -1, np.int32)
            extra[source, np.arange(len(source)) - np.repeat(first, count)] = to
            self.layers[0] = np.concatenate([self.layers[0], extra], 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the nearest `beam` vectors of each query; -1: none. A beam of the graph's size scans it."""
        q = queries.astype(np.float32)
        if beam >= len(self.x):
            return np.broadcast_to(np.arange(len(self.x), dtype=np.int32), (len(q), len(self.x))), q @ self.x.T
        parts = []
        for lo in range(0, len(q), SIDE_BY_SIDE):
            part = q[lo : lo + SIDE_BY_SIDE]
            parts.append(_beam(self.x, self.layers[0], part, self._start(part, self.layers[1:]), beam))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
