import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import engine_queries
from vecspark.config import HnswParams
from vecspark.functions import vector as V
from vecspark.operators import ann
from vecspark.operators.hnsw import HnswGraph, draw_levels
from vecspark.operators.topk import batch_topk, exact_topk, pairwise, recall


def naive(metric, ords, many, q, k):
    d = V.distances(metric, many, q)
    order = np.lexsort((ords, d))[:k]
    return [(int(ords[i]), float(d[i])) for i in order]


def frame(spark, ords, many):
    return spark.createDataFrame([(int(o), v.tolist()) for o, v in zip(ords, many, strict=True)], "ord long, vector array<float>")


def test_ties_go_to_the_lower_ordinal(spark):
    df = frame(spark, range(5), np.array([[0], [10], [3], [7], [4]], np.float32))
    assert [r.ord for r in exact_topk(df, [5], 3).collect()] == [4, 2, 3]
    same = frame(spark, [9, 3, 5], np.ones((3, 2), np.float32))
    assert [r.ord for r in exact_topk(same, [0, 0], 2).collect()] == [3, 5]
    got = batch_topk(same, spark.createDataFrame([(1, [0.0, 0.0])], "qid long, vector array<float>"), 2)
    assert [r.ord for r in got.orderBy("rank").collect()] == [3, 5]


@pytest.mark.parametrize("metric", ["L2", "DOT", "COSINE"])
def test_batch_equals_naive(spark, metric):
    rng = np.random.default_rng(3)
    many = V.prepared(metric, rng.normal(size=(300, 7)))
    many[150:] = many[:150]
    ords = rng.permutation(1000)[:300]
    queries = V.prepared(metric, rng.normal(size=(12, 7)))
    qs = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "qid long, vector array<float>")
    for k in (1, 10, 500):
        got = batch_topk(frame(spark, ords, many).repartition(3), qs, k, metric).orderBy("qid", "rank").collect()
        for i, q in enumerate(queries):
            assert [(r.ord, r.score) for r in got if r.qid == i] == naive(metric, ords, many, q, k)


def test_pairwise_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("vecspark.operators.topk.QUERY_BYTES", 40)
    rng = np.random.default_rng(6)
    many = rng.normal(size=(50, 5)).astype(np.float32)
    points = frame(spark, range(50), many)
    got = pairwise(points.repartition(3), points.where("ord % 10 = 0").withColumnRenamed("ord", "qid")).collect()
    assert len(got) == 250
    for r in got:
        assert r.l2 == V.distances("L2", many[[r.ord]], many[r.qid])[0] and r.dot == V.distances("DOT", many[[r.ord]], many[r.qid])[0]


def test_no_points_and_no_queries(spark):
    none = frame(spark, [], [])
    assert exact_topk(none, [1.0], 3).collect() == []
    qs = spark.createDataFrame([(0, [1.0])], "qid long, vector array<float>")
    assert batch_topk(none, qs, 3).collect() == [] and batch_topk(frame(spark, [1], np.ones((1, 1), np.float32)), qs.limit(0), 3).collect() == []


def test_levels():
    levels = draw_levels(np.arange(200_000), HnswParams())
    for level in range(3):
        assert abs((levels >= level).mean() * 16**level - 1) < 0.15 * (level + 0.1) + 0.02 * 16 ** max(0, level - 1)
    assert (levels == draw_levels(np.arange(200_000), HnswParams())).all() and (levels != draw_levels(np.arange(200_000), HnswParams(seed=1))).any()


def measured(graph, many, queries, metric, k=10, ef=0, eligible=None):
    hit = 0
    for q in queries:
        ords = np.flatnonzero(eligible) if eligible is not None else np.arange(len(many))
        want = {o for o, _ in naive(metric, ords, many[ords], q, k)}
        got, score = graph.search(q, k, ef, eligible)
        assert list(score) == sorted(score) and (V.distances(metric, many[got], q) == score).all()
        assert eligible is None or eligible[got].all()
        hit += len(want & set(got.tolist()))
    return hit / (len(queries) * k)


@pytest.fixture(scope="module")
def gaussian():
    return np.random.default_rng(2024).normal(size=(4000, 32)).astype(np.float32), np.random.default_rng(77).normal(size=(60, 32)).astype(np.float32)


@pytest.mark.parametrize("metric", ["L2", "DOT", "COSINE"])
def test_recall(gaussian, metric):
    many, queries = (V.prepared(metric, x) for x in gaussian)
    graph = HnswGraph.build(metric, HnswParams(), np.arange(len(many)), many)
    assert measured(graph, many, queries, metric) >= 0.90
    assert measured(graph, many, queries, metric, ef=512) > 0.99
    low = measured(graph, many, queries, metric, ef=16)
    assert low <= measured(graph, many, queries, metric, ef=256)


def test_structure(gaussian):
    many, _ = gaussian
    params = HnswParams(m=8)
    graph = HnswGraph.build("L2", params, np.arange(1500), many[:1500])
    again = HnswGraph.build("L2", params, np.arange(1500), many[:1500])
    assert graph.rows() == again.rows() == HnswGraph.from_bytes("L2", params, graph.to_bytes()).rows()
    for layer, lists in enumerate(graph.links):
        assert all(len(x) <= (params.m0 if layer == 0 else params.m) and n not in x and len(set(x.tolist())) == len(x) for n, x in lists.items())
    seen, todo = {graph.entry}, [graph.entry]
    while todo:
        for other in graph.links[0][todo.pop()].tolist():
            if other not in seen:
                seen.add(other)
                todo.append(other)
    assert len(seen) >= 0.99 * 1500


def test_selection_on_clusters():
    rng = np.random.default_rng(12345)
    centres = rng.normal(size=(50, 32)) * 10
    many = (centres[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    queries = (centres[rng.integers(0, 50, 60)] + rng.normal(size=(60, 32))).astype(np.float32)
    found = {s: measured(HnswGraph.build("L2", HnswParams(selection=s), np.arange(3000), many), many, queries, "L2", ef=64) for s in ("SIMPLE", "HEURISTIC")}
    assert found["HEURISTIC"] >= 0.95 and found["HEURISTIC"] >= found["SIMPLE"] - 0.01 and found["SIMPLE"] >= 0.85


@pytest.mark.parametrize("share", [5, 10, 30, 60])
def test_filtered_recall(gaussian, share):
    many, queries = gaussian
    graph = HnswGraph.build("L2", HnswParams(), np.arange(len(many)), many)
    eligible = np.arange(len(many)) % 100 < share
    assert measured(graph, many, queries, "L2", ef=min(4096, 64 * -(-100 // share)), eligible=eligible) >= 0.90


def test_shards(spark, gaussian):
    many, queries = gaussian
    points = frame(spark, range(1200), many[:1200])
    index = ann.build_index(points, "L2", HnswParams(), 300).cache()
    assert index.count() == 4 and index.agg(F.sum("n")).first()[0] == 1200
    qs = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries[:20])], "qid long, vector array<float>")
    truth = batch_topk(points, qs, 10)
    assert recall(ann.search_index(index, qs, 10), truth, 10).first()[0] >= 0.95
    some = points.where("ord % 7 = 0").select("ord")
    got = ann.search_index(index, qs, 10, 448, some, 4)
    assert got.where("ord % 7 <> 0").isEmpty() and recall(got, batch_topk(points.where("ord % 7 = 0"), qs, 10), 10).first()[0] >= 0.95
    assert ann.graph_rows(index).where("layer = 0").count() == 1200


def test_empty_graph():
    graph = HnswGraph.build("L2", HnswParams(), np.zeros(0, np.int64), np.zeros((0, 4), np.float32))
    assert len(graph.search(np.zeros(4, np.float32), 3)[0]) == 0


@pytest.mark.parametrize("metric", ["L2", "DOT", "COSINE"])
@pytest.mark.parametrize("selection", ["SIMPLE", "HEURISTIC"])
def test_many_find_no_less_than_one(gaussian, metric, selection, monkeypatch):
    many, queries = (V.prepared(metric, x) for x in gaussian)
    ords = np.arange(1500) * 3
    graph = HnswGraph.build(metric, HnswParams(selection=selection), ords, many[:1500])
    for ef, eligible in ((0, None), (16, None), (128, ords % 5 < 3), (1280, ords % 20 == 0), (64, ords < 0)):
        allowed = np.arange(1500) if eligible is None else np.flatnonzero(eligible)
        places, got, score = graph.search_many(queries, 10, ef, eligible)
        hits = alone = 0
        for i, q in enumerate(queries):
            own = got[places == i]
            want = {o for o, _ in naive(metric, ords[allowed], many[allowed], q, 10)}
            assert (V.distances(metric, many[own // 3], q) == score[places == i]).all() and np.isin(own, ords[allowed]).all()
            assert len(set(own.tolist())) == len(own) == min(10, len(allowed)) and (np.diff(score[places == i]) >= 0).all()
            hits += len(want & set(own.tolist()))
            alone += len(want & set(graph.search(q, 10, ef, eligible)[0].tolist()))
        assert hits >= alone and (places == np.sort(places)).all()
        # The same for queries that walk by themselves.
        with monkeypatch.context() as patched:
            patched.setattr("vecspark.operators.hnsw.WALK_CELLS", 1)
            patched.setattr("vecspark.operators.hnsw.PAIR_FLOATS", 100)
            assert all((a == b).all() for a, b in zip(graph.search_many(queries, 10, ef, eligible), (places, got, score), strict=True))


def test_many_of_none():
    graph = HnswGraph.build("L2", HnswParams(), np.zeros(0, np.int64), np.zeros((0, 4), np.float32))
    assert [len(x) for x in graph.search_many(np.zeros((2, 4), np.float32), 3)] == [0, 0, 0]
    graph = HnswGraph.build("L2", HnswParams(), np.array([9, 4, 7]), np.ones((3, 4), np.float32))
    assert [len(x) for x in graph.search_many(np.zeros((0, 4), np.float32), 3)] == [0, 0, 0]
    assert [x.tolist() for x in graph.search_many(np.zeros((2, 4), np.float32), 2)] == [[0, 0, 1, 1], [4, 7, 4, 7], [4, 4, 4, 4]]


def test_filter_floors_build_graphs_and_search_them_once(spark, monkeypatch):
    plans, search, reached = [], ann.search_index, engine_queries._reached
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ann, "search_index", lambda index, *rest, **more: plans.append(plan(index)) or search(index, *rest, **more))
    monkeypatch.setattr(engine_queries, "_reached", lambda got, truth: plans.append(plan(got)) or reached(got, truth))
    rows = engine_queries.hnsw_filter_floors(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 8 and not any("Pandas" in x or "Arrow" in x for x in plans)
    assert [tuple(r) for r in rows] == [(share, True, True) for share in (5, 10, 30, 60)]


@pytest.mark.parametrize("bad", [{"m": 1}, {"ef_construction": 0}, {"ef_search": 0}, {"selection": "BEST"}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        HnswParams(**bad)
