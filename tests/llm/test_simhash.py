import random

import numpy as np
import pytest
import xxhash

from vecspark.llm.bk_tree import BkForest
from vecspark.llm.components import connected_components
from vecspark.llm.simhash import fingerprint, near_duplicates, shard_masks, shingle_hashes


def brute_fp(text, k=4):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius, group=None):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (group is None or group[i] == group[j]) and bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near(rng, x, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("seed", range(6))
def test_forest(seed):
    rng = random.Random(seed)
    values, shard = [], []
    for s in range(12):
        base = [rng.getrandbits(64) for _ in range(3)]
        own = sorted({near(rng, rng.choice(base), 9) for _ in range(rng.choice([1, 2, 5, 40, 90]))})
        rng.shuffle(own)
        values += own
        shard += [s] * len(own)
    forest = BkForest(np.array(values, np.uint64), np.array(shard))
    assert forest.components(4).tolist() == brute_components(values, 4, shard)
    got = dict(zip(*map(np.ndarray.tolist, forest.nearest_before(6)), strict=True))
    for i in range(len(values)):
        best = min(((bin(values[i] ^ values[j]).count("1"), j) for j in range(i) if shard[i] == shard[j]), default=(99, 0))
        assert got.get(i) == (best[1] if best[0] <= 6 else None)


def test_forest_dense_and_empty():
    values = np.array([1 << b for b in range(64)] + [0] + [3 << b for b in range(63)], np.uint64)
    assert (BkForest(values, np.zeros(len(values), int)).components(4) == 0).all()
    assert len(BkForest(np.zeros(0, np.uint64), np.zeros(0, int)).components(4)) == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**13])
def test_masks_are_complete(n):
    rng, masks = random.Random(n), shard_masks(n)
    for _ in range(500):
        x = rng.getrandbits(64)
        d = x ^ near(rng, x, 4)
        assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("text", ["", " \t", "One", "one two three", "One two THREE four", "a b c d e f g a b c d", "É é x y z"])
def test_fingerprint(text):
    assert fingerprint(shingle_hashes(text)) % (1 << 64) == brute_fp(text)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)] + [(5, 5)]
    root = {}
    for a, b in edges:
        if a != b:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def make_rows():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    rows = [(None, "null id text"), (-5, None), (-4, ""), (-3, "x " * 50_000), (-2, "one"), (-1, "One")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        for j in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 - 10 * i + j, " ".join(own)))
    return rows + rows[10:14]


@pytest.mark.parametrize("shard_rows", [50_000, 20])
def test_near_duplicates(spark, shard_rows):
    rows = make_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, fp long, component_id string")
    got = near_duplicates(df, shard_rows=shard_rows).collect()
    fps = [brute_fp(t) for _, t in rows]
    label = brute_components(fps, 4)
    lowest = {}
    for (doc, _), x in zip(rows, label, strict=True):
        lowest[x] = min(lowest.get(x, 10**9), 10**9 if doc is None else doc)
    want = sorted((str(doc), f"{fp:016x}", None if lowest[x] == 10**9 else lowest[x]) for (doc, _), fp, x in zip(rows, fps, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
