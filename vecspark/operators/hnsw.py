"""A proximity graph with layers over one shard of points, in numpy.

A node is on layer 0 and on every layer up to its level, which falls off by a factor of M. Its neighbours on a layer are
chosen among the closest nodes that came before it, either the M closest (SIMPLE) or those that no chosen neighbour is
closer to than the node itself (HEURISTIC), and links go both ways; a list that grows beyond its limit is chosen anew. The
nodes before it are found exactly, a block of rows at a time, instead of by walking the unfinished graph.

Many queries walk together, in rounds: each round takes the neighbours of all nodes that the last one has brought among the
ef best, so what a query walks through is at least what it would meet one node at a time."""

from __future__ import annotations

import heapq
import io

import numpy as np

from vecspark.config import HnswParams
from vecspark.functions import vector as V

BUILD_BLOCK = 1024
#: Candidates that a search holds on layers above 0. SIMPLE graphs have few links between groups of points, so more ways down
#: are needed for one to end in the right group.
UPPER_EF = {"HEURISTIC": 16, "SIMPLE": 128}
#: Queries times nodes that walk together, and vector components of what is scored together.
WALK_CELLS, PAIR_FLOATS = 1 << 18, 1 << 18
_NONE = np.iinfo(np.int64).max


def draw_levels(ords: np.ndarray, params: HnswParams) -> np.ndarray:
    """A level for each ordinal, from a seeded hash of it, with P(level >= l) = M ** -l."""
    x = ords.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(params.seed % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.floor(-np.log1p(-u) * params.level_multiplier).astype(np.int32)


def _pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances for building and walking; scores that are reported are summed exactly elsewhere."""
    product = a @ b.T
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * product if metric == "L2" else -product


def select(metric: str, vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int, selection: str) -> np.ndarray:
    """At most ``most`` of ``nodes``, which come by falling closeness ``near`` to the base."""
    if selection == "SIMPLE":
        return nodes[:most]
    own, closest, kept = vectors[nodes], np.full(len(nodes), np.inf, np.float32), []
    for i in range(len(nodes)):
        if closest[i] >= near[i]:
            kept.append(i)
            if len(kept) == most:
                break
            closest = np.minimum(closest, _pairwise(metric, own[i : i + 1], own)[0])
    return nodes[kept]


class HnswGraph:
    """``links[layer]`` maps a node's position to the positions of its neighbours."""

    def __init__(self, metric: str, params: HnswParams, ords: np.ndarray, vectors: np.ndarray, levels: np.ndarray, links: list[dict[int, np.ndarray]]):
        self.metric, self.params, self.ords, self.vectors, self.levels, self.links = metric, params, ords, vectors, levels, links
        self.entry = int(levels.argmax()) if len(levels) else -1

    @classmethod
    def build(cls, metric: str, params: HnswParams, ords: np.ndarray, vectors: np.ndarray) -> HnswGraph:
        """Nodes come in order of their ordinals."""
        order = np.argsort(ords, kind="stable")
        ords, vectors = ords[order], np.ascontiguousarray(vectors[order], np.float32)
        levels = draw_levels(ords, params)
        links = []
        for layer in range(int(levels.max(initial=-1)) + 1):
            links.append(cls._layer(metric, params, vectors, np.flatnonzero(levels >= layer), params.m0 if layer == 0 else params.m))
        return cls(metric, params, ords, vectors, levels, links)

    @staticmethod
    def _layer(metric: str, params: HnswParams, vectors: np.ndarray, nodes: np.ndarray, limit: int) -> dict[int, np.ndarray]:
        lists: dict[int, list[int]] = {int(n): [] for n in nodes}
        own = vectors[nodes]
        for start in range(0, len(nodes), BUILD_BLOCK):
            end = min(start + BUILD_BLOCK, len(nodes))
            d = _pairwise(metric, own[start:end], own[:end])
            d[np.arange(start, end)[:, None] <= np.arange(end)[None]] = np.inf
            for row in range(end - start):
                before = start + row
                if not before:
                    continue
                near = d[row, :before]
                found = np.argpartition(near, params.ef_construction - 1)[: params.ef_construction] if before > params.ef_construction else np.arange(before)
                found = found[np.lexsort((found, near[found]))]
                chosen = select(metric, vectors, nodes[found], near[found], params.m, params.selection)
                base = int(nodes[before])
                lists[base] += chosen.tolist()
                for other in chosen.tolist():
                    lists[other].append(base)
                    if len(lists[other]) > 2 * limit:
                        lists[other] = HnswGraph._shrunk(metric, params, vectors, other, lists[other], limit)
        lists = {n: HnswGraph._shrunk(metric, params, vectors, n, x, limit) if len(x) > limit else x for n, x in lists.items()}
        HnswGraph._connect(metric, vectors, nodes, lists, limit)
        return {n: np.array(x, np.int64) for n, x in lists.items()}

    @staticmethod
    def _connect(metric: str, vectors: np.ndarray, nodes: np.ndarray, lists: dict[int, list[int]], limit: int) -> None:
        """Links what the first node doesn't reach: the closest links alone may leave groups apart."""
        reached: set[int] = set()

        def reach(node: int) -> None:
            reached.add(node)
            todo = [node]
            while todo:
                for other in lists[todo.pop()]:
                    if other not in reached:
                        reached.add(other)
                        todo.append(other)

        if len(nodes):
            reach(int(nodes[0]))
        for node in nodes.tolist():
            if node in reached:
                continue
            room = np.array([n for n in reached if len(lists[n]) < limit] or sorted(reached))
            near = int(room[_pairwise(metric, vectors[node : node + 1], vectors[room])[0].argmin()])
            if len(lists[near]) >= limit:
                lists[near].pop()
            lists[near].append(node)
            if near not in lists[node] and len(lists[node]) < limit:
                lists[node].append(near)
            reach(node)

    @staticmethod
    def _shrunk(metric: str, params: HnswParams, vectors: np.ndarray, base: int, others: list[int], limit: int) -> list[int]:
        nodes = np.array(others)
        near = _pairwise(metric, vectors[base : base + 1], vectors[nodes])[0]
        order = np.lexsort((nodes, near))
        return select(metric, vectors, nodes[order], near[order], limit, params.selection).tolist()

    def _near(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        v = self.vectors[nodes]
        if self.metric == "L2":
            v = v - q
            return np.einsum("ij,ij->i", v, v)
        return -(v @ q)

    def _best_first(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int, eligible: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Up to ``ef`` (distance, node) that are near, from the given ones on."""
        seen = np.zeros(len(self.ords), bool)
        seen[[n for _, n in entries]] = True
        waiting = list(entries)
        heapq.heapify(waiting)
        found = [(-d, -n) for d, n in heapq.nsmallest(ef, [x for x in entries if eligible is None or eligible[x[1]]])]
        heapq.heapify(found)
        links = self.links[layer]
        while waiting:
            d, node = heapq.heappop(waiting)
            if len(found) >= ef and d > -found[0][0]:
                break
            others = links[node]
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            near = self._near(q, others)
            if len(found) >= ef:
                inside = near < -found[0][0]
                others, near = others[inside], near[inside]
            for x, other in zip(near.tolist(), others.tolist(), strict=True):
                if len(found) < ef or x < -found[0][0]:
                    heapq.heappush(waiting, (x, other))
                    if eligible is None or eligible[other]:
                        heapq.heappush(found, (-x, -other))
                        if len(found) > ef:
                            heapq.heappop(found)
        return [(-d, -n) for d, n in found]

    def search(self, q: np.ndarray, k: int, ef: int = 0, eligible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and exact distances of about the k closest nodes, closest first. Nodes that are not eligible (a flag for
        each position) are walked through and never returned."""
        if self.entry < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        ef = max(ef or self.params.ef_search, k)
        near = [(float(self._near(q, np.array([self.entry]))[0]), self.entry)]
        # A few ways down instead of one: distant groups have few links between them, and one way may end in the wrong group.
        for layer in range(len(self.links) - 1, 0, -1):
            near = self._best_first(q, near, UPPER_EF[self.params.selection], layer)
        nodes = np.array([n for _, n in self._best_first(q, near, ef, 0, eligible)], np.int64)
        score = V.distances(self.metric, self.vectors[nodes], q)
        order = np.lexsort((self.ords[nodes], score))[:k]
        return self.ords[nodes[order]], score[order]

    def search_many(self, queries: np.ndarray, k: int, ef: int = 0, eligible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``search`` finds for each of the queries (rows): the query's place, ordinals and exact distances, by place and
        closeness."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if self.entry < 0:
            return out[0]
        links, ef, block = [self._flat(x) for x in self.links], max(ef or self.params.ef_search, k), max(1, WALK_CELLS // len(self.ords))
        for start in range(0, len(queries), block):
            many = queries[start : start + block]
            rows, nodes = np.arange(len(many)), np.full(len(many), self.entry)
            for layer in range(len(links) - 1, 0, -1):
                rows, nodes = self._rounds(many, rows, nodes, UPPER_EF[self.params.selection], links[layer])
            rows, nodes = self._rounds(many, rows, nodes, ef, links[0], eligible)
            # Component by component over contiguous arrays.
            score = self._scored(many, rows, nodes, lambda v, q: V.distances(self.metric, np.asfortranarray(v), np.ascontiguousarray(q.T)))
            order = np.lexsort((self.ords[nodes], score, rows))
            rows, nodes, score = rows[order], nodes[order], score[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append((start + rows[kept], self.ords[nodes[kept]], score[kept]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _flat(self, lists: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A layer's links as (first, others): those of node n are others[first[n] : first[n + 1]]."""
        first = np.zeros(len(self.ords) + 1, np.int64)
        nodes = sorted(lists)
        first[np.array(nodes) + 1] = [len(lists[n]) for n in nodes]
        return np.cumsum(first), np.concatenate([lists[n] for n in nodes]).astype(np.int32)

    def _scored(self, many: np.ndarray, rows: np.ndarray, nodes: np.ndarray, score) -> np.ndarray:
        out, step = np.empty(len(rows), np.float32), max(1, PAIR_FLOATS // many.shape[1])
        for a in range(0, len(rows), step):
            out[a : a + step] = score(self.vectors[nodes[a : a + step]], many[rows[a : a + step]])
        return out

    def _near_pairs(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.metric == "L2":
            v = v - q
            return np.einsum("ij,ij->i", v, v)
        return -np.einsum("ij,ij->i", v, q)

    def _rounds(self, many: np.ndarray, rows: np.ndarray, nodes: np.ndarray, ef: int, links: tuple[np.ndarray, np.ndarray], eligible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``ef`` nodes for each query that are near it, as pairs (row of the query, node) by row, from the given pairs on.

        A node that is beyond the ef best when it is first seen stays beyond, as their limit only falls, so it is dropped at
        once. Distance and node are one number: an order-preserving form of the float above, the node below."""
        (first, others), n, count = links, len(self.ords), len(many)
        width = min(ef, n if eligible is None else int(eligible.sum()))
        if not width:
            return rows[:0], nodes[:0]
        seen, best = np.zeros(count * n, bool), np.full((count, width), _NONE)
        while len(rows):
            seen[rows * n + nodes] = True
            bits = (self._scored(many, rows, nodes, self._near_pairs) + np.float32(0)).view(np.int32)
            near = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32 | nodes
            own = slice(None) if eligible is None else eligible[nodes]
            sizes = np.bincount(rows[own], minlength=count)
            new = np.full((count, int(sizes.max())), _NONE)
            new[rows[own], np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = near[own]
            best = np.concatenate((best, new), axis=1)
            best.partition(width - 1, axis=1)
            best = best[:, :width]
            inside = near <= best[:, -1][rows]
            rows, nodes = rows[inside], nodes[inside]
            sizes = first[nodes + 1] - first[nodes]
            at = np.arange(int(sizes.sum())) + np.repeat(first[nodes] - np.cumsum(sizes) + sizes, sizes)
            fresh = np.zeros(count * n, bool)
            fresh[np.repeat((rows * n).astype(np.int32), sizes) + others[at]] = True
            rows, nodes = np.divmod(np.flatnonzero(fresh & ~seen), n)
        rows, at = np.nonzero(best != _NONE)
        return rows, best[rows, at] & 0xFFFFFFFF

    def to_bytes(self) -> bytes:
        """The graph as plain arrays: a layer's links are its nodes, where each node's neighbours end, and all neighbours."""
        arrays = {"ords": self.ords, "vectors": self.vectors, "levels": self.levels}
        for layer, lists in enumerate(self.links):
            arrays |= {f"nodes{layer}": np.array(list(lists), np.int64), f"ends{layer}": np.cumsum([len(x) for x in lists.values()], dtype=np.int64), f"links{layer}": np.concatenate(list(lists.values()))}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, metric: str, params: HnswParams, data: bytes) -> HnswGraph:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            links = []
            for layer in range(sum(name.startswith("nodes") for name in held.files)):
                ends, others = held[f"ends{layer}"].tolist(), held[f"links{layer}"]
                links.append({n: others[a:b] for n, a, b in zip(held[f"nodes{layer}"].tolist(), [0, *ends], ends, strict=False)})
            return cls(metric, params, held["ords"], held["vectors"], held["levels"], links)

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        """(ord, level, layer, ordinals of neighbours) of every list."""
        return [(int(self.ords[n]), int(self.levels[n]), layer, self.ords[x].tolist()) for layer, lists in enumerate(self.links) for n, x in lists.items()]
