"""Numpy solvers of graph fixpoints for graphs that fit one process.  Nodes are 0 to n-1."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and targets of each node's edges."""
    order = np.argsort(src, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(src, minlength=n))], dst[order]


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    if n == 0:
        return np.zeros(0)
    out = np.bincount(src, minlength=n)
    score = np.full(n, 1.0 / n)
    for _ in range(iterations):
        flow = np.bincount(dst, weights=score[src] / out[src], minlength=n)
        new = (1 - damping) / n + damping * (flow + score[out == 0].sum() / n)
        moved = np.abs(new - score).sum()
        score = new
        if moved < tolerance:
            break
    return score / score.sum()


def walk_weights(n: int, lost: list[float], damping: float, iterations: int) -> list[np.ndarray]:
    """After each number of iterations, how much a score has of each mass of walks; lost: by round, the mass of nodes without edges out, none beyond."""
    lost = np.r_[lost, np.zeros(max(0, iterations + 1 - len(lost)))][: iterations + 1]
    weights = [np.r_[1.0 / n, np.zeros(iterations)]]
    for _ in range(iterations):
        now = weights[-1]
        weights.append(np.r_[(1 - damping) / n + damping * float(now @ lost) / n, damping * now[:-1]])
    return weights


def distances(n: int, src: np.ndarray, dst: np.ndarray, start: int) -> np.ndarray:
    """Steps from start to each node, -1 where there is no path."""
    first, to = adjacency(n, src, dst)
    dist = np.full(n, -1, np.int64)
    dist[start] = 0
    front, k = np.array([start]), 0
    while len(front):
        k += 1
        near = np.unique(np.concatenate([to[first[x] : first[x + 1]] for x in front]))
        front = near[dist[near] < 0]
        dist[front] = k
    return dist


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least member of each node's strongly connected component, by two passes over the graph and its reverse."""
    first, to = (x.tolist() for x in adjacency(n, src, dst))
    seen, order = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, first[root])]
        while stack:
            v, k = stack.pop()
            while k < first[v + 1] and seen[to[k]]:
                k += 1
            if k < first[v + 1]:
                stack.append((v, k + 1))
                seen[to[k]] = True
                stack.append((to[k], first[to[k]]))
            else:
                order.append(v)
    first, to = (x.tolist() for x in adjacency(n, dst, src))
    label = [-1] * n
    for root in reversed(order):
        if label[root] >= 0:
            continue
        label[root], group, stack = root, [root], [root]
        while stack:
            v = stack.pop()
            for u in to[first[v] : first[v + 1]]:
                if label[u] < 0:
                    label[u] = root
                    group.append(u)
                    stack.append(u)
        least = min(group)
        for v in group:
            label[v] = least
    return np.array(label, np.int64)


def layers(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Longest path to a node without edges out; -1 for nodes that lead into a cycle or loop."""
    left = np.bincount(src, minlength=n)
    first, back = adjacency(n, dst, src)
    level = np.full(n, -1, np.int64)
    front, k = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = k
        k += 1
        up = np.concatenate([back[first[x] : first[x + 1]] for x in front])
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        front = up[(left[up] == 0) & (level[up] < 0)]
    return level


def betweenness(n: int, src: np.ndarray, dst: np.ndarray, sources: Iterable[int], cells: int = 8_000_000) -> np.ndarray:
    """Dependency sums of the given sources over (n-1)(n-2), level by level.

    Sources go in blocks whose states, one for each source and node, fill at most
    ``cells`` places; a step serves the whole block.
    """
    first, to = adjacency(n, src, dst)
    total = np.zeros(n)
    sources = np.fromiter(sources, np.int64)
    block = min(max(1, cells // max(1, n)), max(1, len(sources)))
    dist = np.full(block * n, -1, np.int32)
    paths, share = np.zeros(block * n), np.zeros(block * n)
    for at in range(0, len(sources), block):
        own = sources[at : at + block]
        root = np.arange(len(own)) * n + own
        dist[root], paths[root] = 0, 1.0
        levels, front, seen = [], root, [root]
        while len(front):
            node = front % n
            count = first[node + 1] - first[node]
            a = np.repeat(front, count)
            near = np.arange(len(a)) - np.repeat(np.cumsum(count) - count - first[node], count)
            b = a - a % n + to[near]
            new = np.unique(b[dist[b] < 0])
            dist[new] = len(levels) + 1
            on = dist[b] == len(levels) + 1
            a, b = a[on], b[on]
            np.add.at(paths, b, paths[a])
            levels.append((a, b))
            seen.append(new)
            front = new
        for a, b in reversed(levels):
            np.add.at(share, a, paths[a] / paths[b] * (1 + share[b]))
        share[root] = 0
        # only the places that were reached are counted and cleared
        touched = np.concatenate(seen)
        np.add.at(total, touched % n, share[touched])
        dist[touched], paths[touched], share[touched] = -1, 0, 0
    return total / max(1, (n - 1) * (n - 2))


def crossings(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """How many ordered pairs of other nodes have a path through each node, where none has more than one edge out and none a loop.

    In a tree those are the nodes before times the nodes behind.  On a cycle of m nodes
    a path that entered it j steps before ends at one of m - 1 - j nodes behind.
    """
    to = np.full(n, -1, np.int64)
    to[src] = dst
    left, size, behind = np.bincount(dst, minlength=n), np.ones(n, np.int64), np.zeros(n, np.int64)
    crossed = np.zeros(n, np.int64)
    fronts, front = [], np.flatnonzero(left == 0)
    while len(front):
        fronts.append(front)
        front = front[to[front] >= 0]
        np.add.at(size, to[front], size[front])
        np.subtract.at(left, to[front], 1)
        up = np.unique(to[front])
        front = up[left[up] == 0]
    seen = left == 0
    for root in np.flatnonzero(~seen):
        if seen[root]:
            continue
        ring, v = [], root
        while not seen[v]:
            seen[v] = True
            ring.append(v)
            v = to[v]
        at, m = np.array(ring), len(ring)
        w, place = size[at], np.arange(m)
        later = w.sum() - np.cumsum(w)
        crossed[at] = (w - 1) * (m - 1) + (m - 1) * (w.sum() - w) - (place * w.sum() - (w * place).sum() + m * later)
        behind[at] = m - 1
    for front in reversed(fronts):
        front = front[to[front] >= 0]
        behind[front] = behind[to[front]] + 1
        crossed[front] = (size[front] - 1) * behind[front]
    return crossed
