import json
import random

import pytest
from pyspark.sql import functions as F

from vecspark.functions import metadata as M
from vecspark.plans.filters import And, Eq, In, Or, Range, parse
from vecspark.plans.planner import plan_column, plan_counts


#: Values that a field may have on some points; several types in one field.
DOMAINS = {"colour": ["red", "green", "blue", "7"], "weight": [-1.5, 0.0, 2.0, 7.0, 1e9], "size": ["s", "m", 7.0, True, False], "sold": [True, False]}


def random_fields(rng):
    return {name: rng.choice(values) for name, values in DOMAINS.items() if rng.random() < 0.7}


def random_filter(rng, depth=2):
    if depth and rng.random() < 0.5:
        return rng.choice([And, Or])(tuple(random_filter(rng, depth - 1) for _ in range(rng.randint(1, 3))))
    name, anything = rng.choice(list(DOMAINS)), [v for values in DOMAINS.values() for v in values] + [7, 0]
    if rng.random() < 0.4:
        return Eq(name, rng.choice(anything))
    if rng.random() < 0.5:
        return In(name, tuple(rng.sample(anything, rng.randint(1, 5))))
    sides = rng.choice([("gt",), ("lte",), ("gte", "lt"), ("gt", "lte"), ("gte", "lte")])
    return Range(rng.choice(["weight", "size"]), **{s: rng.choice([-2, 0, 2, 7, 8]) for s in sides})


def test_columns_equal_the_evaluator(spark):
    rng = random.Random(12)
    rows = [random_fields(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, *M.split(r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} {v}" for k, v in M.TYPES.items())).cache()
    chosen = [random_filter(rng) for _ in range(60)]
    got = df.agg(*[F.collect_set(F.when(f.column(), F.col("i"))).alias(f"f{n}") for n, f in enumerate(chosen)]).first()
    for n, f in enumerate(chosen):
        assert sorted(got[n]) == [i for i, r in enumerate(rows) if f.matches(r)], f


def test_parse():
    tree = {"or": [{"field": "colour", "in": ["red", 7]}, {"and": [{"field": "weight", "range": {"gt": 1, "lte": 7}}, {"field": "sold", "eq": True}]}]}
    f = parse(json.loads(json.dumps(tree)))
    assert f == Or((In("colour", ("red", 7)), And((Range("weight", gt=1, lte=7), Eq("sold", True)))))
    assert f.matches({"weight": 7.0, "sold": True}) and not f.matches({"weight": 7.0, "sold": "true"}) and f.matches({"colour": 7.0})


@pytest.mark.parametrize("tree", [
    None, 5, [], "x", {}, {"field": "a"}, {"field": 3, "eq": 1}, {"eq": 1}, {"field": "a", "eq": 1, "in": [1]}, {"field": "a", "eq": 1, "x": 2}, {"field": "a", "like": "b"}, {"and": {}}, {"and": []}, {"or": []},
    {"and": [{"field": "a", "eq": 1}], "or": []}, {"and": [3]}, {"field": "a", "in": 3}, {"field": "a", "in": []}, {"field": "a", "in": [None]}, {"field": "a", "eq": None}, {"field": "a", "eq": [1]}, {"field": "a", "eq": float("nan")},
    {"field": "a", "range": 3}, {"field": "a", "range": {}}, {"field": "a", "range": {"ge": 3}}, {"field": "a", "range": {"gt": "3"}}, {"field": "a", "range": {"gt": True}}, {"field": "a", "range": {"gt": 1, "gte": 2}}, {"field": "a", "range": {"lt": float("inf")}}])
def test_malformed(tree):
    with pytest.raises(ValueError):
        parse(tree)


def test_depth():
    tree = {"field": "a", "eq": 1}
    for _ in range(16):
        tree = {"and": [tree]}
    parse(tree)
    with pytest.raises(ValueError, match="16 levels"):
        parse({"or": [tree]})


def test_contradictions_and_zero(spark):
    df = spark.createDataFrame([(0, *M.split({"x": -0.0})), (1, *M.split({"x": 5})), (2, *M.split({"x": "5"}))], "i int, " + ", ".join(f"{k} {v}" for k, v in M.TYPES.items()))
    ids = lambda f: [r.i for r in df.where(f.column()).collect()]
    assert ids(Range("x", gt=5, lt=3)) == ids(Range("x", gt=5, lte=5)) == ids(Range("x", gt=-0.0, lt=1)) == []
    assert ids(Range("x", gte=-0.0, lte=0.0)) == [0] and ids(Eq("x", 5)) == [1] and ids(In("x", (5, "5"))) == [1, 2]


@pytest.mark.parametrize("bad", [{"a": None}, {"a": [1]}, {"a": {}}, {"": 1}, {"x" * 129: 1}, {"a": float("inf")}, {"a": 10**400}, {3: 1}])
def test_bad_metadata(bad):
    with pytest.raises(ValueError):
        M.split(bad)


def test_metadata_json():
    fields = {"s": "é", "n": 3, "z": -0.0, "b": True}
    assert M.from_json(M.to_json(fields)) == {"s": "é", "n": 3.0, "z": 0.0, "b": True}


def test_planner(spark):
    assert plan_counts(0, 10, 5, 0, 64).strategy == "NO_MATCH" and plan_counts(0, 0, 5, 0, 64).selectivity == 0
    assert plan_counts(19, 1000, 5, 0, 64).strategy == "EXACT_SCAN"
    at = plan_counts(20, 1000, 5, 0, 64)
    assert (at.strategy, at.selectivity, at.ef) == ("FILTERED_INDEX", 0.02, 64 * 50)
    assert plan_counts(20, 1000, 100, 200, 64).ef == 4096 and plan_counts(500, 1000, 100, 0, 64).ef == 200 and plan_counts(46, 500, 10, 0, 64).ef == 704
    with pytest.raises(ValueError):
        plan_counts(1, 1, 0, 0, 64)
    cases = [(0, 10), (1, 100), (2, 100), (50, 100), (3, 500), (100, 100)]
    rows = spark.createDataFrame(cases, "m long, n long").select("m", "n", *plan_column(F.col("m"), F.col("n"), 10, 0, 64)).collect()
    for r in rows:
        p = plan_counts(r.m, r.n, 10, 0, 64)
        assert (r.strategy, r.selectivity, r.ef) == (p.strategy, p.selectivity, p.ef)
