import math
import random
import zlib
from collections import Counter
from itertools import accumulate

import pytest

from vecspark.llm import sharding
from vecspark.llm.sharding import communication_matrix, hypergeometric, hypergeometric_shards


def test_hypergeometric_is_exact():
    rng, n = random.Random(3), 20_000
    seen = Counter(hypergeometric(rng, 4, 6, 5) for _ in range(n))
    want = {0: 6, 1: 60, 2: 120, 3: 60, 4: 6}
    assert all(abs(seen[k] / n - w / 252) < 0.012 for k, w in want.items()) and set(seen) <= set(want)


SIZES = [(20_000, 30_000, 10_000), (400, 399_600, 90_000), (70_000, 300, 60_000)]


@pytest.mark.parametrize(("sizes", "wide"), [(s, w) for s in SIZES for w in (0.0, 1e18)] + [((10**11, 10**12, 10**8), 0.0)])
def test_both_ways_to_draw_have_the_law(monkeypatch, sizes, wide):
    """Quantiles of what is drawn against the sums of probabilities, by rejection and by inversion."""
    good, bad, draws = sizes
    monkeypatch.setattr(sharding, "WIDE", wide)
    rng, n = random.Random(8), 4000
    seen = sorted(hypergeometric(rng, good, bad, draws) for _ in range(n))
    if draws > 10**6:
        mean, deviation = draws * good / (good + bad), math.sqrt(draws * good / (good + bad) * (bad / (good + bad)))
        below = lambda x: 0.5 * (1 + math.erf((x + 0.5 - mean) / deviation / math.sqrt(2)))
    else:
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        low, high = max(0, draws - bad), min(good, draws)
        sums = list(accumulate(math.exp(choose(good, k) + choose(bad, draws - k) - choose(good + bad, draws)) for k in range(low, high + 1)))
        below = lambda x: sums[x - low]
    assert all(abs((i + 1) / n - below(x)) < 0.04 for i, x in enumerate(seen) if i + 1 == n or seen[i + 1] > x)


def test_matrix_sums():
    rows, room = [5, 0, 17, 8], [10, 10, 10]
    m = list(communication_matrix(rows, room, 1))
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m)] == room


def check(rows, df, shards):
    got = df.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = Counter(r.shard for r in got)
    assert sum(by.values()) == len(rows) and all(len(rows) // shards <= by[s] <= -(-len(rows) // shards) for s in range(shards))
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append((t or "").encode())
    for r in got:
        assert any(r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) for t in text[r.doc_id]) and r.law == "rows" and r.grown_shard is None
    return got


def test_shards(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else "é" * (i % 50)) for i in range(3000)] + [(7, "again"), (7, "again"), (None, "n"), (-1, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, row int")
    got = check(rows, hypergeometric_shards(df, 24, bucket_rows=20), 24)
    again = hypergeometric_shards(df, 24, bucket_rows=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    first = Counter(r.shard for r in got if r.doc_id is not None and 0 <= r.doc_id < 1000)
    assert max(first.values()) < 2.2 * min(first.values())


def test_few_and_none(spark):
    assert hypergeometric_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check([(1, "a")], hypergeometric_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string")), 24)


def test_the_shuffle_is_uniform(spark, monkeypatch):
    """Where rows go doesn't depend on where they were, nor on their neighbours; and the matrix is what the sources sent."""
    monkeypatch.setattr(sharding, "CHUNK", 2)
    df, n, shards = spark.range(0, 4800, 1, 5).selectExpr("id AS doc_id", "'t' AS text"), 4800, 6
    for seed in (1, 2):
        place = {r.doc_id: r.shard * 800 + r.slot for r in hypergeometric_shards(df, shards, seed=seed, bucket_rows=30).collect()}
        assert sorted(place.values()) == list(range(n))
        cells = Counter((i * 8 // n, place[i] * 8 // n) for i in range(n))
        assert sum((cells[a, b] - 75) ** 2 / 75 for a in range(8) for b in range(8)) < 95  # chi-square with 49 degrees of freedom
        assert abs(sum(place[i] < place[i + 1] for i in range(n - 1)) - n / 2) < 100
        steps = Counter(min(abs(place[i] - place[i + 1]) * 4 // n, 3) for i in range(n - 1))
        assert all(abs(steps[k] - n * (7 - 2 * k) / 16) < 150 for k in range(4))
        assert sum(abs(place[i] - place[i + 1]) == 1 for i in range(n - 1)) < 12
