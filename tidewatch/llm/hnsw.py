"""Hierarchical navigable small-world graphs over unit vectors, in numpy.

Layers are built from the top. A layer's nodes enter in batches: each is searched in the layer as it
stands, from the node that the finished layer above finds for it, and linked to neighbours that are
closer to it than to each other. Searches run for many queries at once, in steps that expand each
query's best unexpanded nodes.
"""

from __future__ import annotations

import io

import numpy as np

WIDTH = 16  # links that a new node makes in a layer
SLOTS = 2 * WIDTH  # links that a node keeps
STEP = 4  # nodes that a query expands at once


def levels(ids: np.ndarray) -> np.ndarray:
    """A level for each id by its hash, geometric as the layers need."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(float) + 1) / 2.0**53
    return np.minimum((-np.log(u) / np.log(WIDTH)).astype(int), 8)


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query: node numbers, best first and -1 at the end, and similarities.

    entries: a start node for each query."""
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    ids[:, 0] = entries
    sims[:, 0] = np.einsum("bd,bd->b", x[entries], queries)
    seen = np.zeros((b, n), bool)
    seen[np.arange(b), entries] = True
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        best = np.argsort(-open_, axis=1, kind="stable")[:, : min(STEP, beam)]
        go = np.take_along_axis(open_, best, 1) > -np.inf
        alive = go.any(1)
        active, best, go = active[alive], best[alive], go[alive]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, best] |= go
        nodes = np.where(go, ids[rows, best], -1)
        near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows, np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("kd,kd->k", x[near[r, c]], queries[active[r]])
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
        all_sims = np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    return ids, sims


def choose(x: np.ndarray, node: int, near: np.ndarray, most: int) -> np.ndarray:
    """Of near (best first), those closer to node than to one already chosen; the rest fill up to most."""
    near = near[:64]
    if len(near) <= 1:
        return near
    to_node, between = x[near] @ x[node], x[near] @ x[near].T
    order = np.argsort(-to_node, kind="stable")
    chosen: list[int] = []
    blocked = np.full(len(near), -np.inf)
    for k in order:
        if to_node[k] >= blocked[k]:
            chosen.append(int(k))
            np.maximum(blocked, between[k], out=blocked)
            if len(chosen) == most:
                break
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [int(k) for k in order if int(k) not in taken][: most - len(chosen)]
    return near[chosen]


class Graph:
    """A graph over the unit vectors x, whose ids give the levels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, beam: int = 48, batch: int = 64):
        self.x, self.ids = np.ascontiguousarray(x, np.float32), np.asarray(ids, np.int64)
        self.layers: list[np.ndarray] = []  # from the top
        if not len(x):
            return
        level = levels(self.ids)
        order = np.lexsort((self.ids, -level))
        for at in range(int(level.max()), -1, -1):
            self.layers.append(self._layer(order[level[order] >= at], beam, batch))

    def _layer(self, nodes: np.ndarray, beam: int, batch: int) -> np.ndarray:
        x, n = self.x, len(self.x)
        links = np.full((n, SLOTS + WIDTH), -1, np.int64)
        used = np.zeros(n, np.int64)

        def add(a: int, others: np.ndarray) -> None:
            for o in others.tolist():
                if used[o] == links.shape[1]:
                    kept = choose(x, o, links[o], SLOTS)
                    links[o, : len(kept)], links[o, len(kept) :] = kept, -1
                    used[o] = len(kept)
                links[o, used[o]] = a
                used[o] += 1

        inside = 0
        while inside < len(nodes):
            new = nodes[inside : inside + (batch if inside else min(batch, 32))]
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            if inside:
                entry = self._entries(x[new], nodes[0])
                found, sims = search(x, links, x[new], entry, beam)
            else:
                found, sims = np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf)
            for k, node in enumerate(new.tolist()):
                ids = np.concatenate([found[k], new[:k]])
                s = np.concatenate([sims[k], own[k, :k]])
                good = ids >= 0
                ids, s = ids[good], s[good]
                picked = choose(x, node, ids[np.argsort(-s, kind="stable")], WIDTH)
                links[node, : len(picked)], used[node] = picked, len(picked)
                add(node, picked)
            inside += len(new)
        return links

    def _entries(self, queries: np.ndarray, first: int) -> np.ndarray:
        at = np.full(len(queries), first, np.int64)
        for links in self.layers:
            at = search(self.x, links, queries, at, STEP)[0][:, 0]
        return at

    def query(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of the beams; queries are unit vectors."""
        queries = np.ascontiguousarray(queries, np.float32)
        if not self.layers:
            return np.full((len(queries), 0), -1), np.zeros((len(queries), 0), np.float32)
        top = int(np.flatnonzero((self.layers[0] >= 0).any(1))[0]) if (self.layers[0] >= 0).any() else int(np.lexsort((self.ids, -levels(self.ids)))[0])
        at = np.full(len(queries), top, np.int64)
        for links in self.layers[:-1]:
            at = search(self.x, links, queries, at, STEP)[0][:, 0]
        return search(self.x, self.layers[-1], queries, at, min(beam, len(self.x)))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, **{f"l{i}": v.astype(np.int32) for i, v in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> Graph:
        z = np.load(io.BytesIO(blob))
        g = cls.__new__(cls)
        g.x, g.ids = z["x"], z["ids"]
        g.layers = [z[f"l{i}"].astype(np.int64) for i in range(len(z.files) - 2)]
        return g


def both_ways(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's neighbours start, and the neighbours: those it links to and those that link to it."""
    a, c = np.nonzero(links >= 0)
    b = links[a, c]
    edges = np.unique(np.concatenate((a * len(links) + b, b * len(links) + a)))
    a, b = np.divmod(edges, len(links))
    return np.searchsorted(a, np.arange(len(links) + 1)), b


def _onwards(neighbours: tuple[np.ndarray, np.ndarray], exact: np.ndarray, queries: np.ndarray, q: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (q, v) with those that lead on from them: neighbours of a query's links that are links as well."""
    n, (start, near) = len(exact), neighbours
    known = np.unique(q * n + v)
    qs, vs = [q], [v]
    while len(v):
        count = start[v + 1] - start[v]
        at = np.repeat(start[v] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        keys = np.unique(np.repeat(q, count) * n + near[at])
        fresh = np.setdiff1d(keys, known, assume_unique=True)
        known = np.union1d(known, fresh)
        q, v = np.divmod(fresh, n)
        good = np.concatenate([np.einsum("kd,kd->k", exact[v[i : i + 65536]], queries[q[i : i + 65536]]) >= least for i in range(0, len(v), 65536)] or [np.zeros(0, bool)])
        q, v = q[good], v[good]
        qs.append(q)
        vs.append(v)
    return np.concatenate(qs), np.concatenate(vs)


def links_of(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, audit: int = 64, beam: int = 32, recall: float = 0.999) -> tuple[np.ndarray, np.ndarray, dict]:
    """Query numbers and nodes of cosine >= least, and how the audit went.

    exact: the graph's vectors in double precision, as are the queries. From the links in its beam, a query goes on to
    their neighbours, of links in either direction, as long as these are links. Beams widen, for all queries while
    an audit of `audit` queries against every node finds too few of their links, and for single queries
    while their whole beam is at or above the limit. Half of the audited queries are even ones of all, half
    of those for which the first beams find a link, so that an audit has links to miss where there are any."""
    n, near = len(graph.x), least - 1e-4  # of single precision; candidates are checked in double
    none = np.zeros(0, np.int64)
    if not n or not len(queries):
        return none, none, {"hit": 0, "total": 0, "beam": 0}
    even = lambda of, most: of[np.unique(np.linspace(0, len(of) - 1, min(most, len(of))).astype(int))]
    truth: dict[int, np.ndarray] = {}
    neighbours = both_ways(graph.layers[-1])
    while True:
        qs, vs = [none], [none]
        todo, width = np.arange(len(queries)), beam
        step = max(1, min(128, 8_000_000 // n))
        while len(todo):
            again = []
            for lo in range(0, len(todo), step):
                block = todo[lo : lo + step]
                ids, sims = graph.query(queries[block], width)
                full = (sims >= near).all(1) & (ids.shape[1] < n)
                again.extend(block[full].tolist())
                r, c = np.nonzero((sims >= near) & ~full[:, None])
                if len(r):
                    good = np.einsum("kd,kd->k", exact[ids[r, c]], queries[block[r]]) >= least
                    r, v = _onwards(neighbours, exact, queries[block], r[good], ids[r, c][good], least)
                    qs.append(block[r])
                    vs.append(v)
            todo, width = np.array(again, np.int64), 2 * width
        q, v = np.concatenate(qs), np.concatenate(vs)
        if not truth:
            linked = np.unique(q)
            told = np.union1d(even(np.arange(len(queries)), audit // 2), even(linked, audit // 2) if len(linked) else none)
            truth = {int(k): np.flatnonzero(exact @ queries[k] >= least) for k in told}
        total = sum(map(len, truth.values()))
        hit = sum(len(np.intersect1d(v[q == k], t)) for k, t in truth.items() if len(t))
        if hit >= recall * total or beam >= n:
            return q, v, {"hit": int(hit), "total": int(total), "beam": beam}
        beam *= 2
