"""Communities by multi-level modularity with refinement, one project at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.graph import PropertyGraph

#: Levels of more nodes move many nodes at a time: all levels, so that no result depends on a graph's size. Other values are for comparison.
TOGETHER = 0


def leiden(n: int, pairs, weights=None, resolution: float = 1.0, seed: int = 1):
    """Communities of n nodes joined by pairs (m, 2): local moving, splitting to connected parts, aggregation, until nothing changes."""
    import numpy as np

    rng = np.random.default_rng(seed)
    pairs = np.asarray(pairs, np.int64).reshape(-1, 2)
    w = np.ones(len(pairs)) if weights is None else np.asarray(weights, float)
    whole = np.arange(n)
    while True:
        size = int(whole.max(initial=-1)) + 1
        loops = pairs[:, 0] == pairs[:, 1]
        deg = np.bincount(pairs[:, 0], w, size) + np.bincount(pairs[:, 1], w, size)
        total = deg.sum() or 1.0
        a = np.concatenate([pairs[~loops], pairs[~loops][:, ::-1]])
        order = np.argsort(a[:, 0], kind="stable")
        dst, ww = a[order, 1], np.concatenate([w[~loops], w[~loops]])[order]
        at = np.searchsorted(a[order, 0], np.arange(size + 1))
        if size > TOGETHER:
            com = _moved_together(a[order, 0], dst, ww, deg, total, resolution, rng)
        else:
            com = _moved_singly(at, dst, ww, deg, total, resolution, rng)
        com = _connected(size, pairs, com)
        if com.max(initial=-1) + 1 == size:
            return whole
        whole = com[whole]
        p, n = np.sort(com[pairs], axis=1), int(com.max()) + 1
        key, inverse = np.unique(p[:, 0] * n + p[:, 1], return_inverse=True)
        w = np.bincount(inverse, w, len(key))
        pairs = np.stack([key // n, key % n], axis=1)


def _moved_singly(at, dst, ww, deg, total, resolution, rng):
    """Local moving, one node after the other: each goes to the community around it that gains most."""
    import numpy as np

    size = len(deg)
    com, mass = np.arange(size), deg.copy()
    moved = True
    rounds = 0
    while moved and rounds < 20:
        moved, rounds = False, rounds + 1
        for v in rng.permutation(size):
            s = slice(at[v], at[v + 1])
            if s.start == s.stop:
                continue
            near, where = np.unique(com[dst[s]], return_inverse=True)
            gain = np.bincount(where, ww[s]) - resolution * deg[v] * (mass[near] - deg[v] * (near == com[v])) / total
            stay = gain[near == com[v]] if (near == com[v]).any() else np.array([-resolution * deg[v] * (mass[com[v]] - deg[v]) / total])
            best = int(gain.argmax())
            if near[best] != com[v] and gain[best] > stay[0] + 1e-12:
                mass[com[v]] -= deg[v]
                com[v] = near[best]
                mass[com[v]] += deg[v]
                moved = True
    return com


def _moved_together(src, dst, ww, deg, total, resolution, rng):
    """Local moving of many nodes at a time, in numpy: of a random part of them each goes to the community around it that gains most.

    Modularity is measured after each round; a round that lowers it is taken back and the part halves. src is sorted.
    """
    import numpy as np

    size = len(deg)
    com, mass, share, best_q, few = np.arange(size), deg.copy(), 0.5, -np.inf, 0
    for _ in range(100 if len(src) else 0):
        order = np.argsort(src * np.int64(size) + com[dst], kind="stable")
        s, c = src[order], com[dst[order]]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
        s, c, w = s[first], c[first], np.add.reduceat(ww[order], first)
        own = c == com[s]
        gain = w - resolution * deg[s] * (mass[c] - deg[s] * own) / total
        stay = -resolution * deg * (mass[com] - deg) / total
        stay[s[own]] = gain[own]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        most = np.maximum.reduceat(gain, start)
        at_most = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[start, len(s)])))
        v, k = np.unique(s[at_most], return_index=True)
        to = c[at_most[k]]
        better = (to != com[v]) & (most > stay[v] + 1e-12) & (rng.random(len(v)) < share)
        if not better.any():
            few += 1
            if few == 3:
                break
            continue
        before = com.copy()
        com[v[better]] = to[better]
        mass = np.bincount(com, deg, size)
        q = (ww[com[src] == com[dst]].sum() - resolution * (mass * mass).sum() / total) / total
        if q < best_q:
            com, share = before, share / 2
            mass = np.bincount(com, deg, size)
            if share < 0.05:
                break
            continue
        few = few + 1 if q - best_q < 1e-5 else 0
        best_q = q
        if few == 3:
            break
    return com


def _connected(n: int, pairs, com):
    """Communities split into their connected parts, numbered from 0."""
    import numpy as np

    root = np.arange(n)
    inside = pairs[com[pairs[:, 0]] == com[pairs[:, 1]]] if len(pairs) else pairs
    while len(inside):
        a, b = root[inside[:, 0]], root[inside[:, 1]]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return np.unique(root, return_inverse=True)[1]


def communities(g: PropertyGraph, types: tuple = ("CALLS",), resolution: float = 1.0) -> DataFrame:
    """(project, id, community): the community is the smallest id in it. A project goes to one task, whatever its size."""
    e = g.of_type(*types).select("project", "source_id", "target_id").filter("source_id <> target_id")
    e = e.select("project", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()

    def run(key, t):
        import numpy as np
        import pyarrow as pa

        ids, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        com = leiden(len(ids), at.reshape(2, -1).T, resolution=resolution)
        least = np.full(com.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, com, ids)
        return pa.table({"project": pa.repeat(key[0], len(ids)), "id": ids, "community": least[com]})

    return e.groupBy("project").applyInArrow(run, "project string, id long, community long")
