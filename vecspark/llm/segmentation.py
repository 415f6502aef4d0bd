"""Sampled SentencePiece segmentations, distinct by Gumbel top-k, and decoding.

The segmentations of a text are the paths of a lattice. A BPE vocabulary gives ranks and no probabilities, so a piece has
the Zipf-Mandelbrot weight 1 / (rank + SHIFT) to the power of ``alpha``, and a path's probability is the product of its
pieces' weights over the sum for all paths. A perturbed A-star search draws k paths without replacement: every path has
its log probability plus a Gumbel variable as its score, and the k highest are wanted. A node of the search is a set of
paths with a common beginning; its bound is the highest score inside, a Gumbel variable about the set's log mass, and given
the bound a best path inside is drawn by walking down the lattice. What branches off along the walk becomes new nodes,
whose bounds are Gumbel variables cut off at the walked node's bound. So a node's bound is met by the path drawn from it,
the search never turns back, and the paths come out in the order of their scores, all distinct.

No piece crosses a space or line break, so the lattice is a chain of word lattices. Those of a batch's distinct words are
held together but built in portions, and walks go through all words of a part of the batch's texts at once, whose rows are
given before the next part's, so that a worker's memory is little more than these lattices. Random numbers are hashes of the seed,
the row's key, the sample, the word and the step, so a row has the same samples wherever and however often it is computed.

The inclusion score of a path is the logarithm of the probability that its score exceeds the highest score not drawn,
log(1 - exp(-exp(log p - threshold))); 0 if nothing was left undrawn.

Nulls: a null text is an empty one, which has one segmentation without pieces; a null doc_id is the key 0. Rows with equal
doc_id and text have equal samples. Texts with fewer than k segmentations give all that there are. An empty table gives an
empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from vecspark.llm.common import bounded_batches, small_batches, text_of, texts
from vecspark.llm.language_id import HashTable

SHIFT = 2.7
#: Words longer than this are summed in logarithms, and those with a path of a lower log weight: a product of bytes' weights
#: may be below the smallest float (e^-708) in words that are much shorter.
LONG_WORD, LEAST_LOG = 60, -650.0
#: Places of a path that are looked at first for branches; noise is below MOST_NOISE, as ``uniform`` is below 1 - 2^-53.
FIRST_PLACES, MOST_NOISE = 128, 36.8
#: Characters of distinct words whose lattices are built together, and of texts that are walked together (one at least of
#: each); places of paths that are looked at together. They bound memory and change no result.
BUILT_CHARACTERS, WALKED_CHARACTERS, MOST_PLACES = 50_000, 500_000, 1 << 18
_SPACE = 0x2581
_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_BASE, _STEP, _WORD, _SAMPLE = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near keys give unrelated numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers over 0 and under 1."""
    return ((mixed(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """A BPE model's pieces, reachable by the hashes of their beginnings. A symbol is a piece's id, or for a character that
    no piece has the number of pieces plus its code point: it stands for the character's bytes."""

    def __init__(self, path: str, alpha: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        special = {i for i in range(self.size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.log_weight = np.array([-alpha * np.log(max(0.0, -min(model.get_score(i), 0.0)) % 1e9 + SHIFT) for i in range(self.size)])
        self.log_byte = -alpha * np.log(self.size + SHIFT)
        found: dict[int, int] = {}
        self.longest = 1
        for i, name in enumerate(names):
            if i in special:
                continue
            h = 0
            points = [ord(c) for c in name]
            self.longest = max(self.longest, len(points))
            for k, c in enumerate(points):
                h = (h * int(_BASE) + c + 1) % (1 << 64)
                found[h] = i if k == len(points) - 1 else found.get(h, -1)
        keys = np.fromiter(found, np.uint64, len(found))
        self.starts = HashTable(keys, np.fromiter(found.values(), np.int64, len(found))[:, None], absent=-2)
        bytes_of = [b"" if i in special else names[i].replace("▁", " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.byte_ids.tolist()):
            bytes_of[i] = bytes([b])
        self.lengths = np.fromiter(map(len, bytes_of), np.int64, self.size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols) or symbols.max() < self.size:
            return symbols.astype("<u4")
        parts, last = [], 0
        for at in np.flatnonzero(symbols >= self.size).tolist():
            parts += [symbols[last:at].astype("<u4"), self.byte_ids[list(chr(int(symbols[at]) - self.size).encode())].astype("<u4")]
            last = at + 1
        return np.concatenate([*parts, symbols[last:].astype("<u4")])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of a whole text, without the space that encoding puts before it."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + lengths, lengths)
        out = self.flat[at].tobytes().decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _portions(strings: list[str], most: int) -> Iterator[slice]:
    """Slices of about ``most`` characters each, one string at least."""
    start = total = 0
    for i, s in enumerate(strings):
        if i > start and total + len(s) > most:
            yield slice(start, i)
            start, total = i, 0
        total += len(s)
    if start < len(strings):
        yield slice(start, len(strings))


@lru_cache(maxsize=2)
def shared_vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattices:
    """The lattices of many words. A node is a place in a word; edges are sorted by the node they leave. ``log_p`` is an
    edge's log probability among those of its node, and ``within`` the sum of probabilities of its node's edges up to it."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        # Portions are appended to arrays with room for what is to come, as joining them at the end would take twice the memory.
        whole, size, nodes, edges, todo = {}, {}, 0, 0, sum(map(len, words)) + len(words)
        for portion in _portions(words, BUILT_CHARACTERS):
            self._build(words[portion], vocabulary)
            before, nodes = nodes, nodes + len(self.final)
            self.root += before
            self.source += before
            self.target += before
            self.first = self.first[:-1] + edges
            edges += len(self.symbol)
            for name, new in vars(self).items():
                n = size.get(name, 0)
                size[name] = n + len(new)
                if size[name] >= len(whole.get(name, ())):
                    longer = np.empty(max(size[name] + 1, size[name] * todo // nodes * 11 // 10), new.dtype)
                    longer[:n] = whole.get(name, new)[:n]
                    whole[name] = longer
                whole[name][n : size[name]] = new
        whole["first"][nodes] = edges
        size["first"] += 1
        for name, array in whole.items():
            setattr(self, name, array[: size[name]])

    def _build(self, words: list[str], vocabulary: Vocabulary) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        self.root = ends - sizes
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        points[points == 0x20] = _SPACE
        end_of = np.repeat(ends, sizes + 1)
        self.final = np.zeros(len(points), bool)
        self.final[ends] = True
        at = np.flatnonzero(~self.final)
        start, hashes, table = at, np.zeros(len(at), np.uint64), vocabulary.starts
        steps = []
        counts = np.zeros(len(points), np.int64)
        covered = np.zeros(len(points), bool)
        for length in range(1, vocabulary.longest + 1):
            inside = start + length <= end_of[start]
            start, hashes = start[inside], hashes[inside]
            if not len(start):
                break
            hashes = hashes * _BASE + points[start + length - 1].astype(np.uint64) + np.uint64(1)
            value = table.values[table.find(hashes), 0].astype(np.int64)
            known = value >= 0
            own, symbols = start[known], value[known]
            if length == 1:
                covered[own] = True
                alone = at[~covered[at]]
                own, symbols = np.concatenate((own, alone)), np.concatenate((symbols, vocabulary.size + points[alone].astype(np.int64)))
            steps.append((length, own, symbols, counts[own]))
            counts[own] += 1
            going = value >= -1
            start, hashes = start[going], hashes[going]
        self.first = np.concatenate(([0], np.cumsum(counts)))
        n = int(self.first[-1])
        self.source = np.repeat(np.arange(len(points), dtype=np.int32), counts)
        self.target, self.symbol = np.empty(n, np.int32), np.empty(n, np.int32)
        for length, own, symbols, rank in steps:
            place = self.first[own] + rank
            self.target[place], self.symbol[place] = own + length, symbols
        lone = self.symbol >= vocabulary.size
        weight = vocabulary.log_weight[np.where(lone, 0, self.symbol)]
        if lone.any():
            c = self.symbol[lone] - vocabulary.size
            weight[lone] = vocabulary.log_byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        self.log_mass = np.zeros(len(points))
        left = np.minimum(end_of - np.arange(len(points)), LONG_WORD + 1)
        # A node's first edge is one character, so this is the path of single characters, and no mass is below its weight.
        alone = np.zeros(len(points))
        alone[at] = weight[self.first[at]]
        long = np.repeat((sizes > LONG_WORD) | (np.add.reduceat(alone, self.root) < LEAST_LOG), sizes + 1)
        self._backward(at[~long[at]][np.argsort(left[at[~long[at]]].astype(np.uint8), kind="stable")], left, weight, False)
        if long.any():
            own = at[long[at]]
            distance = end_of - np.arange(len(points))
            self._backward(own[np.argsort(distance[own], kind="stable")], distance, weight, True)
        self.log_p = np.minimum(weight + self.log_mass[self.target] - self.log_mass[self.source], 0.0)
        total = np.cumsum(np.exp(self.log_p))
        self.within = total - np.concatenate(([0.0], total))[self.first[self.source]]
        # The last edge of a node ends at 1 whatever the rounding.
        self.within[self.first[1:][counts > 0] - 1] = 1.0

    def _backward(self, nodes: np.ndarray, distance: np.ndarray, weight: np.ndarray, logs: bool) -> None:
        """Log masses of the paths from ``nodes``, which come by their distance from the end, to it."""
        if not len(nodes):
            return
        counts = self.first[nodes + 1] - self.first[nodes]
        ends = np.cumsum(counts)
        edges = np.arange(ends[-1]) + np.repeat(self.first[nodes] - ends + counts, counts)
        weights = weight[edges] if logs else np.exp(weight[edges])
        targets, heads = self.target[edges], ends - counts
        mass = self.log_mass if logs else np.ones(len(self.log_mass))
        cuts = [*np.flatnonzero(np.append(True, distance[nodes][1:] != distance[nodes][:-1])).tolist(), len(nodes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = int(heads[a]), int(ends[b - 1])
            part = slice(low, high)
            mass[nodes[a:b]] = np.logaddexp.reduceat(weights[part] + mass[targets[part]], heads[a:b] - low) if logs else np.add.reduceat(weights[part] * mass[targets[part]], heads[a:b] - low)
        if not logs:
            self.log_mass[nodes] = np.log(mass[nodes])

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each node to the end of its word: edges, node after node, and how many each has."""
        counts, parts, step = np.zeros(len(nodes), np.int64), [], 0
        live = np.flatnonzero(~self.final[nodes])
        at, keys = nodes[live], keys[live]
        while len(live):
            edge, u = self.first[at], uniform(keys + np.uint64(step) * _STEP)
            further = np.flatnonzero(self.within[edge] < u)
            while len(further):
                edge[further] += 1
                further = further[self.within[edge[further]] < u[further]]
            parts.append((live, edge))
            counts[live] += 1
            at = self.target[edge]
            on = ~self.final[at]
            live, at, keys = live[on], at[on], keys[on]
            step += 1
        offsets = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for step, (live, edge) in enumerate(parts):
            out[offsets[live] + step] = edge
        return out, counts


class _Text:
    """The search for one text: paths drawn so far, and the best open nodes as (bound, path, place, edges gone before, log
    probability before the place)."""

    __slots__ = ("paths", "words_of", "open", "bounds", "first_word", "last_word")

    def __init__(self, first_word: int, last_word: int):
        self.paths: list[np.ndarray] = []
        self.words_of: list[np.ndarray] = []
        self.open: list[tuple[float, int, int, tuple[int, ...], float]] = []
        self.bounds: list[float] = []
        self.first_word, self.last_word = first_word, last_word


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def sample_batch(many: list[str], keys: np.ndarray, k: int, vocabulary: Vocabulary) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k segmentations or fewer, by falling score: symbols, log probability, score, inclusion score."""
    return list(chain.from_iterable(sample_parts(many, keys, k, vocabulary)))


def sample_parts(many: list[str], keys: np.ndarray, k: int, vocabulary: Vocabulary) -> Iterator[list[list[tuple[np.ndarray, float, float, float]]]]:
    """What ``sample_batch`` gives, for one part of the texts after the other."""
    index: defaultdict[str, int] = defaultdict(count().__next__)
    words = []
    for t in many:
        units = _UNITS.findall(" " + t) if t else []
        words.append(np.fromiter(map(index.__getitem__, units), np.int32, len(units)))
    if not index:
        yield [[(np.zeros(0, np.int64), 0.0, 0.0, 0.0)] for _ in many]
        return
    lattices = Lattices(list(index), vocabulary)
    del index
    for part in _portions(many, WALKED_CHARACTERS):
        yield _sampled(words[part], keys[part], k, lattices)


def _sampled(words_of_texts: list[np.ndarray], keys: np.ndarray, k: int, lattices: Lattices) -> list[list[tuple[np.ndarray, float, float, float]]]:
    word = np.concatenate(words_of_texts)
    ends = np.cumsum([len(x) for x in words_of_texts])
    starts = np.concatenate(([0], ends[:-1]))
    found = [_Text(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]
    roots = lattices.root[word]
    keys = mixed(keys.astype(np.uint64))
    word_keys = np.repeat(keys, ends - starts) + (np.arange(len(word)) - np.repeat(starts, ends - starts)).astype(np.uint64) * _WORD
    with np.errstate(divide="ignore", over="ignore"):
        for sample in range(k):
            salt = np.uint64(sample + 1) * _SAMPLE
            # Of each: text, bound, path before the walk, its words, first new place, log probability before it.
            todo: list[tuple[int, float, np.ndarray, np.ndarray, int, float]] = []
            from_nodes, from_words = [], []
            for i, t in enumerate(found):
                if not t.last_word - t.first_word:
                    continue
                if sample == 0:
                    bound = float(_gumbel(uniform(keys[i : i + 1] + salt))[0])
                    todo.append((i, bound, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0.0))
                    from_nodes.append(roots[t.first_word : t.last_word])
                    from_words.append(np.arange(t.first_word, t.last_word))
                    continue
                if not t.open:
                    continue
                best = max(range(len(t.open)), key=lambda j: t.open[j][0])
                bound, path, place, gone, prefix = t.open.pop(best)
                at = t.paths[path][place]
                node = int(lattices.source[at])
                a, b = int(lattices.first[node]), int(lattices.first[node + 1])
                left = [e for e in range(a, b) if e not in gone]
                p = np.exp(lattices.log_p[left])
                u, v = uniform(np.array([keys[i] + salt * np.uint64(3), keys[i] + salt * np.uint64(5)])).tolist()
                edge = left[min(int(np.searchsorted(np.cumsum(p), u * p.sum())), len(left) - 1)]
                word_at = int(t.words_of[path][place])
                if len(left) > 1:
                    rest = np.log(sum(np.exp(lattices.log_p[e]) for e in left if e != edge)) + prefix
                    t.open.append((float(-np.logaddexp(-bound, -(rest + _gumbel(np.array(v))))), path, place, (*gone, edge), prefix))
                todo.append((i, bound, np.append(t.paths[path][:place], edge), np.append(t.words_of[path][:place], word_at), place + 1, prefix + float(lattices.log_p[edge])))
                from_nodes += [lattices.target[edge : edge + 1], roots[word_at + 1 : t.last_word]]
                from_words.append(np.arange(word_at, t.last_word))
            if not todo:
                break
            nodes, words = np.concatenate(from_nodes), np.concatenate(from_words)
            edges, counts = lattices.walk(nodes, word_keys[words] + salt)
            words_of = np.repeat(words, counts)
            cuts = np.cumsum(np.concatenate(([0], counts)))[np.cumsum([0, *(len(x) for x in from_words)])]
            step_of = np.arange(len(edges)) - np.repeat(np.cumsum(counts) - counts, counts)
            own_keys = word_keys[words_of]
            most = k - sample
            # Of all nodes that branch off, no more can matter than samples that are still to come, and the threshold; and
            # none whose log mass and largest possible noise stay below those. So only paths where that can't be told from
            # their first places are looked at as a whole; masses only fall along a path.
            lows, lengths = cuts[:-1], np.diff(cuts)
            before_p = np.array([x[5] for x in todo])
            bounds = np.array([x[1] for x in todo])
            groups = [(np.arange(len(todo)), np.minimum(lengths, FIRST_PLACES))]
            while groups:
                rows, widths = groups.pop()
                width = int(widths.max(initial=0))
                if not width:
                    continue
                if len(rows) * width > MOST_PLACES and len(rows) > 1:
                    half = len(rows) // 2
                    groups += [(rows[:half], widths[:half]), (rows[half:], widths[half:])]
                    continue
                inside = np.arange(width) < widths[:, None]
                place = np.where(inside, lows[rows][:, None] + np.arange(width), 0)
                own = edges[place]
                log_p = np.where(inside, lattices.log_p[own], 0.0)
                sums = before_p[rows][:, None] + np.cumsum(log_p, axis=1)
                prefix = sums - log_p
                node = lattices.source[own]
                others = np.log1p(-np.exp(log_p))
                others[~inside | (lattices.first[node + 1] - lattices.first[node] == 1)] = -np.inf
                noise = _gumbel(uniform(own_keys[place] + salt * np.uint64(7) + step_of[place].astype(np.uint64) * _STEP))
                cut = -np.logaddexp(-bounds[rows][:, None], -(prefix + others + noise))
                top = np.argsort(-cut, axis=1, kind="stable")[:, :most]
                best = np.take_along_axis(cut, top, axis=1)
                lowest = best[:, -1] if top.shape[1] == most else np.full(len(rows), -np.inf)
                done = (widths == lengths[rows]) | (lowest > sums[:, -1] + MOST_NOISE)
                again = np.flatnonzero(~done)
                if len(again):
                    groups.append((rows[again], np.minimum(lengths[rows[again]], 4 * widths[again])))
                for r, row in zip(np.flatnonzero(done).tolist(), rows[done].tolist(), strict=True):
                    i, _, before, _, new, _ = todo[row]
                    found[i].open += [(float(c), sample, new + int(j), (int(own[r, j]),), float(prefix[r, j])) for j, c in zip(top[r], best[r], strict=True) if c > -np.inf]
            for (i, bound, before, before_words, _, _), a, b in zip(todo, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t = found[i]
                t.paths.append(np.concatenate((before, edges[a:b])) if len(before) else edges[a:b])
                t.words_of.append(np.concatenate((before_words, words_of[a:b])) if len(before) else words_of[a:b])
                t.bounds.append(bound)
    out = []
    for t in found:
        if not t.paths:
            out.append([(np.zeros(0, np.int64), 0.0, 0.0, 0.0)])
            continue
        threshold = max((o[0] for o in t.open), default=-np.inf)
        rows = []
        for path, bound in zip(t.paths, t.bounds, strict=True):
            log_p = float(lattices.log_p[path].sum())
            x = log_p - threshold
            rows.append((lattices.symbol[path], log_p, bound, 0.0 if threshold == -np.inf else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x))
        out.append(rows)
    return out


def segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 0, alpha: float = 1.0, digest: bool = False) -> DataFrame:
    """A row for each sample: doc_id, rank (from 1), n_tokens, log_p, score, log_inclusion, decoded (whether decoding gives
    the text), ids, and with ``digest`` their crc32 too (little-endian unsigned 32-bit integers)."""
    bounded_batches(docs.sparkSession)
    base = "doc_id long, rank int, n_tokens long, log_p double, score double, log_inclusion double, decoded boolean, ids array<int>"
    schema = base + ", ids_crc32 long" * digest
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def rows_of(docs_of: list[int | None], many: list[str], part: list[list[tuple[np.ndarray, float, float, float]]], vocabulary: Vocabulary) -> pa.RecordBatch:
        rows, parts = [], []
        for doc, text, found in zip(docs_of, many, part, strict=True):
            # A word-separator sign in the text itself comes back as the space that it stands for.
            want = text.replace("▁", " ")
            for rank, (symbols, log_p, score, inclusion) in enumerate(found, 1):
                ids = vocabulary.ids(symbols)
                rows.append((doc, rank, len(ids), log_p, score, inclusion, vocabulary.decode(ids) == want))
                parts.append(ids)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).view(np.int32))))
        if digest:
            columns.append(pa.array([zlib.crc32(x) for x in parts], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared_vocabulary(model_path, alpha)
        for batch in small_batches(batches, "text"):
            docs_of, many = batch.column("doc_id").to_pylist(), texts(batch, "text")
            keys = mixed(np.array([(d or 0) % (1 << 64) for d in docs_of], np.uint64)) + np.uint64(seed % (1 << 64)) * _STEP
            at = 0
            for part in sample_parts(many, keys, k, vocabulary):
                yield rows_of(docs_of[at : at + len(part)], many[at : at + len(part)], part, vocabulary)
                at += len(part)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(sampled, schema)
