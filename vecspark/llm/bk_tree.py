"""BK-trees over 64-bit fingerprints, many at a time, as arrays.

Every node's children are keyed by their integer Hamming distance to it, so a query that is d away from a node need only
follow the edges from d - r to d + r. Trees are built and searched level by level with array operations, a whole forest of
shards at once: each shard is a tree of its own."""

from __future__ import annotations

import numpy as np

#: Pairs of query and node that one step of a search holds.
FRONTIER = 1 << 20


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class BkForest:
    """``values``: fingerprints, distinct within a shard; ``shard``: ascending numbers of the shards they belong to."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values, n = values, len(values)
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        self.parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        self.levels = [first]
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[waiting]
        while len(waiting):
            key = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            keys, leads, inverse = np.unique(key, return_index=True, return_inverse=True)
            nodes = waiting[leads]
            self.parent[nodes], edge[nodes] = keys // 65, keys % 65
            self.levels.append(nodes)
            rest = np.ones(len(waiting), bool)
            rest[leads] = False
            waiting, at = waiting[rest], nodes[inverse[rest]]
        placed = np.flatnonzero(self.parent >= 0)
        keys = self.parent[placed] * 65 + edge[placed]
        order = np.argsort(keys, kind="stable")
        self.child_keys, self.children = keys[order], placed[order]

    def _follow(self, query: np.ndarray, node: np.ndarray, distance: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(self.child_keys, node * 65 + np.maximum(distance - radius, 0))
        counts = np.searchsorted(self.child_keys, node * 65 + np.minimum(distance + radius, 64), side="right") - low
        return np.repeat(query, counts), self.children[_ranges(low, counts)]

    def components(self, radius: int) -> np.ndarray:
        """For each value the smallest index in its component, where values of a shard within ``radius`` are linked.

        Queries come in growing blocks. A branch whose nodes are all in the query's component has no news and is left out,
        so a dense group is searched once, not once for each of its members."""
        n = len(self.values)
        label = np.arange(n)
        done, block = 0, 64
        order = np.concatenate(self.levels) if n else np.zeros(0, np.int64)
        while done < n:
            queries, done = order[done : done + block], done + block
            same = self._uniform(label)
            stack = [(queries, self.root[queries])]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                news = same[node] != label[query]
                query, node = query[news], node[news]
                if not len(query):
                    continue
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (distance <= radius) & (label[query] != label[node])
                found.append((query[hit], node[hit]))
                stack.append(self._follow(query, node, distance, radius))
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            if len(a):
                label = merged(label, label[a], label[b])
            block = min(2 * block, 1 << 16)
        return label

    def _uniform(self, label: np.ndarray) -> np.ndarray:
        """For each node the label that its whole branch has, else -1."""
        out = label.copy()
        for nodes in self.levels[:0:-1]:
            up = self.parent[nodes]
            np.minimum.at(out, up[out[nodes] != out[up]], -1)
        return out

    def nearest_before(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For each value that has any: its index, and the index of the nearest value within ``radius`` among those that
        come before it in its shard (of equal ones the first)."""
        n = len(self.values)
        best = np.full(n, (radius + 1) << 40, np.int64)
        stack = [(np.arange(n), self.root.copy())]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            if not len(query):
                continue
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            before = node < query
            np.minimum.at(best, query[before], (distance[before] << 40) | node[before])
            # Branches that only hold later or farther values can't improve on the best so far.
            open_ = best[query] >> 40
            low = np.searchsorted(self.child_keys, node * 65 + np.maximum(distance - open_, 0))
            counts = np.searchsorted(self.child_keys, node * 65 + np.minimum(distance + open_, 64), side="right") - low
            query, node = np.repeat(query, counts), self.children[_ranges(low, counts)]
            later = node < query  # a node is the first of its branch
            stack.append((query[later], node[later]))
        has = np.flatnonzero(best >> 40 <= radius)
        return has, best[has] & ((1 << 40) - 1)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its component) after labels a and b are joined."""
    to = np.arange(len(label))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(to, high, low)
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        a, b = to[a], to[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return to[label]
