import random

import numpy as np
import pytest

from vecspark.llm import simhash
from vecspark.llm.common import BitFilter, matching, without
from vecspark.llm.simhash import bands_of, drop_near_copies, fingerprint, similar_texts


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows if shingles(t)]
    root = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[a], root[b]), key=lambda d: (d is None, d))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def make(seed, groups, most):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = [(None, "no id at all here"), (-1, None), (-2, ""), (-3, "one two"), (-4, "One  TWO"), (-5, "very long " * 30_000)]
    n = 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            n += 1
            rows.append((n, " ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "groups", "most", "part_rows"), [(1, 80, 5, 1024), (2, 6, 60, 1024), (3, 6, 60, 25)])
def test_recall_and_precision(spark, seed, groups, most, part_rows):
    rows = make(seed, groups, most)
    df = spark.createDataFrame([(*r, 0, [1]) for r in rows], "doc_id long, text string, owner long, bands array<int>")
    got = {r.doc_id: r.component_id for r in similar_texts(df, part_rows=part_rows).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    wrong = sum(got[d] != want[d] for d in want)
    assert wrong <= 0.01 * len(want)
    assert len({(got[d], want[d]) for d in want}) >= len(set(want.values()))  # no group joins two


def test_empty(spark):
    assert similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filters(spark):
    docs = spark.createDataFrame([(i, f"t{i}", {"a": i}, 2) for i in range(500)] + [(None, "n", None, None), (3, "again", None, 1)], "doc_id long, text string, bits map<string,int>, `in filter` int")
    ids = spark.createDataFrame([(3,), (77,), (9999,)], "doc_id long")
    assert sorted(r.text for r in matching(docs.drop("bits"), ids, "doc_id").collect()) == ["again", "t3", "t77"]
    left = without(docs, ids, "doc_id")
    assert left.columns == docs.columns and left.count() == 499 and left.where("doc_id is null").count() == 1
    assert BitFilter(ids, "doc_id").marked(docs.select("doc_id")).where("in_filter").count() < 10
    assert without(docs, ids.limit(0), "doc_id").count() == 502 and without(docs.limit(0), ids, "doc_id").count() == 0


def sharing_a_passage(seed, pairs):
    """Pairs of texts at 0.83 whose members are at 0.74 to all others."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = words(304), []
    for n in range(pairs):
        both = words(20)
        rows += [(2 * n, " ".join(passage + both + words(33))), (2 * n + 1, " ".join(passage + both + words(33)))]
    rng.shuffle(rows)
    return rows


def edited_copies(seed, count):
    """Copies with edits of their own, most of them at about 0.8 to each other."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(300)], []
    for n in range(count):
        own = list(base)
        for at in rng.sample(range(300), 7):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(own)))
    return rows


def bridged(seed, groups, first, second):
    """Two groups of edited copies each, joined by one pair of texts at 0.8 or more."""
    rng, rows = random.Random(seed), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for g in range(groups):
        base = words(200)
        far = base[:186] + words(14)
        for base, count in ((base, first), (far, second)):
            for _ in range(count):
                own = list(base)
                own[rng.randrange(20, 180)] = f"x{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(own)))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(far[:100] + base[100:]))]
    rng.shuffle(rows)
    return rows


def chain(seed, count):
    """Texts of which only neighbours are similar."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100 + 8 * count)]
    return [(n, " ".join(words[8 * n : 8 * n + 100])) for n in rng.sample(range(count), count)]


@pytest.mark.parametrize(("rows", "step", "part_rows"), [(sharing_a_passage(4, 200), 1024, 1024), (sharing_a_passage(5, 150), 60, 70), (edited_copies(6, 400), 1024, 1024), (edited_copies(7, 300), 50, 40), (bridged(8, 4, 100, 30), 1024, 1024), (bridged(9, 3, 100, 30), 32, 25), (chain(10, 150), 20, 20)])
def test_large_shards_equal_brute_force(spark, monkeypatch, rows, step, part_rows):
    monkeypatch.setattr(simhash._rest, "__defaults__", (part_rows, 1 << 20))
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=step).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("shingles", [10, 30, 100, 400])
def test_few_pairs_at_the_limit_are_missed_as_candidates(shingles):
    """Of pairs at 0.8 those that share no band or lie beyond the radius."""
    rng, missed = np.random.default_rng(shingles), 0
    for _ in range(600):
        both, rest = np.split(rng.integers(0, 1 << 64, shingles, np.uint64), [int(np.ceil(0.8 * shingles))])
        a, b = np.concatenate((both, rest[::2])), np.concatenate((both, rest[1::2]))
        far = ((fingerprint(a) ^ fingerprint(b)) & (1 << 64) - 1).bit_count() > simhash.TEXT_RADIUS
        missed += far or not (bands_of(a) == bands_of(b)).any()
    assert missed <= 0.005 * 600


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(7, text, 0), (5, near, 1), (5, near, 2), (None, text, 3), (7, other, 4), (None, "", 5), (None, "alone", 6), (None, "alone", 7), (3, None, 8)]
    docs = spark.createDataFrame([(d, t, i, "x") for d, t, i in rows], "doc_id long, text string, row long, whole string").coalesce(1)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == [1, 4, 5, 6, 8]
    got = sorted(((r.doc_id, r.component_id) for r in similar_texts(docs).collect()), key=str)
    assert got == sorted([(7, 5), (5, 5), (5, 5), (None, 5), (7, 7), (None, None), (None, None)], key=str)
