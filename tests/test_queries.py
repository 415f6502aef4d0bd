import numpy as np
import pytest

from vecspark import queries as core
from vecspark.functions import vector as V


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    rng, folder = np.random.default_rng(8), str(tmp_path_factory.mktemp("points"))
    many, labels = rng.normal(size=(1200, 16)).astype(np.float32), rng.integers(0, 8, 1200)
    spark.createDataFrame([(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(many, labels, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, many * (1 + np.arange(1200) % 7).astype(np.float32)[:, None], labels


@pytest.mark.parametrize(("name", "allowed"), [("hnsw_knn", range(8)), ("hnsw_filtered", [1, 2, 3])])
def test_graph_searches_cover_the_table(spark, points, name, allowed):
    folder, many, labels = points
    eligible, got = np.flatnonzero(np.isin(labels, list(allowed))), {}
    for r in core.queries()[name](spark, folder).collect():
        got.setdefault(r.qid, set()).add(r.ord)
    assert set(got) == set(range(0, 1200, 50))
    found = 0
    for q, ords in got.items():
        nearest = eligible[np.argsort(V.distances("L2", many[eligible], many[q]), kind="stable")[:10]]
        assert ords <= set(eligible.tolist())
        found += len(ords & set(nearest.tolist()))
    assert found >= 0.9 * 10 * len(got)


def test_recalls_cover_the_table(spark, points, monkeypatch):
    asked, batch = [], core.batch_topk
    monkeypatch.setattr(core, "batch_topk", lambda points, queries, *a: asked.append({r.qid for r in queries.collect()}) or batch(points, queries, *a))
    assert core.recall_at_k(spark, points[0]).first().recall >= 0.9
    assert core.recall_of_exact(spark, points[0]).first().recall == 1
    assert asked == [set(range(0, 1200, 50))] * 2
