import random
import zlib

import numpy as np
import pytest

from vecspark.llm.rule_ensemble import STATISTICS, Rule, RuleEnsemble, classify, extract_rules, keep_accepted, lasso_logistic, statistics, train


def good(rng):
    return " ".join(rng.choice(["water", "people", "little", "sound", "great", "where", "through", "before"]) + str(rng.randrange(200)) + rng.choice(["", "", "."]) for _ in range(rng.randint(30, 120)))


def bad(rng):
    if rng.random() < 0.5:
        return " ".join(rng.choice(["water", "people"]) + rng.choice(["###", "&&&", "$$$"]) for _ in range(rng.randint(30, 120)))
    return "buy this now\n" * rng.randint(10, 60)


def make(n=400):
    rng = random.Random(4)
    labels = [int(rng.random() < 0.7) for _ in range(n)]
    return [(i, (good if y else bad)(rng)) for i, y in enumerate(labels)], list(enumerate(labels))


def test_statistics():
    for text in ("", " \n", "x", "###", "A.B c\nA.B c\n", "é日本 1", "long " * 50_000, "\x00"):
        found = statistics(text)
        assert len(found) == len(STATISTICS) and np.isfinite(found).all()
    s = dict(zip(STATISTICS, statistics("aa bb aa bb\naa bb aa bb"), strict=True))
    assert s["distinct_words"] == 0.25 and s["dup_lines"] == 0.5 and s["top_word"] == 0.5


def test_lasso_is_sparse_and_optimal():
    rng = np.random.default_rng(0)
    a = np.column_stack([np.ones(600), rng.integers(0, 2, (600, 8))]).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * a[:, 1] - 1)))).astype(float)
    w = lasso_logistic(a, y, 0.02, np.zeros(9), steps=3000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y) / len(y)
    assert abs(g[0]) < 1e-4 and (w[2:] == 0).sum() >= 4 and w[1] > 0.5
    for j in range(1, 9):
        assert abs(g[j] + 0.02 * np.sign(w[j])) < 1e-4 if w[j] else abs(g[j]) <= 0.02 + 1e-6


def test_rules_are_paths():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.3)).astype(float)
    rules = extract_rules(x, y)
    assert len({r.bounds for r in rules}) == len(rules) and all(1 <= len(r.bounds) <= 3 for r in rules)
    model = train(x, y)
    p = model.score(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97 and len(model.rules) < len(rules)


def test_columns_equal_numpy(spark):
    model = RuleEnsemble(-0.5, [Rule(((0, -np.inf, 2.0), (3, 0.1, np.inf)), 1.5), Rule(((1, 0.5, 3.0),), -2.0)])
    rng = np.random.default_rng(2)
    x = rng.random((50, len(STATISTICS))) * 4
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"stat_{s} double" for s in STATISTICS))
    got = [r[0] for r in df.select(model.column("stat_")).collect()]
    assert np.allclose(got, model.score(x))


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = make()
    odd = [(1000, None), (1001, ""), (None, "no id"), (1002, "word " * 100_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows + odd], "doc_id long, text string, stat_chars double, label string")
    marks = spark.createDataFrame([(d, y, 0) for d, y in labels] + [(None, 1, 0), (1001, None, None), (7, labels[7][1], 1)], "doc_id long, quality int, toxic int")
    return docs, marks, dict(labels), rows + odd


def test_held_out(tables):
    docs, marks, labels, rows = tables
    got = classify(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(held) >= 0.97 * len(held)
    assert sorted(map(str, got)) == sorted(map(str, classify(docs.repartition(5), marks).collect()))


def test_keep(tables):
    docs, marks, labels, rows = tables
    kept = keep_accepted(docs, marks)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in classify(docs, marks).collect() if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_poor_labels(spark, tables):
    docs, marks, _, rows = tables
    assert {r.score for r in classify(docs, marks.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in classify(docs, marks.where("quality = 1")).collect())
    assert classify(docs.limit(0), marks).collect() == []
    assert len(classify(docs, marks.limit(12)).collect()) == len(rows)


def test_scores_equal_brute_force(tables):
    """The whole query against a model that is fitted and applied on plain lists."""
    docs, marks, labels, rows = tables
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text or "")
    learned = sorted((d, y) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5)
    model = train(np.array([min(statistics(t) for t in texts[d]) for d, _ in learned]), np.array([float(y) for _, y in learned]))
    got = {}
    for r in classify(docs, marks).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, many in texts.items():
        want = sorted(model.score(np.array([statistics(t) for t in many])).tolist())
        assert np.allclose(sorted(r.score for r in got[doc]), want, atol=1e-9) and all(r.predicted == int(r.score >= 0.3) for r in got[doc])
