import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import vector as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_answers(spark):
    a, b = V.literal([0, 0]), V.literal([3, 4])
    assert one(spark, V.squared_l2(a, b))[0] == 25
    assert one(spark, V.distance("DOT", V.literal([1, 2, 3]), V.literal([4, -5, 6])))[0] == -12
    unit = lambda v: V.normalize(V.literal(v))
    row = one(spark, V.distance("COSINE", unit([1, 0]), unit([5, 0])), V.distance("COSINE", unit([1, 0]), unit([-2, 0])), V.distance("COSINE", unit([1, 0]), unit([0, 3])))
    assert list(row) == [-1, 1, 0] and not np.signbit(np.float32(row[2]))


@pytest.mark.parametrize("v", [[3, 4], [3e30, 4e30]])
def test_normalize(spark, v):
    assert np.allclose(one(spark, V.normalize(V.literal(v)))[0], [0.6, 0.8]) and np.allclose(V.prepared("COSINE", np.array([v]))[0], [0.6, 0.8])


@pytest.mark.parametrize("v", [[0, 0], [float("inf"), 1]])
def test_cannot_normalize(spark, v):
    with pytest.raises(Exception, match="cannot normalize"):
        one(spark, V.normalize(V.literal(v)))
    with pytest.raises(ValueError, match="cannot normalize"):
        V.prepared("COSINE", np.array([v]))


def test_dimensions_must_agree(spark):
    with pytest.raises(Exception, match="dimension mismatch: 2 vs 3"):
        one(spark, V.dot(V.literal([1, 2]), V.literal([1, 2, 3])))


@pytest.mark.parametrize("metric", ["L2", "DOT", "COSINE"])
def test_column_and_numpy_agree_bit_for_bit(spark, metric):
    rng = np.random.default_rng(5)
    many, q = rng.normal(size=(200, 17)).astype(np.float32) * 3, rng.normal(size=17).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(many)], "i int, v array<float>")
    rows = df.select("i", V.distance(metric, V.prepare(metric, F.col("v")), V.prepare(metric, V.literal(q))).alias("d")).collect()
    got = np.array([r.d for r in sorted(rows, key=lambda r: r.i)], np.float32)
    want = V.distances(metric, V.prepared(metric, many), V.prepared(metric, q[None])[0])
    assert (got == want).all()
    wide = V.prepared(metric, many).astype(float), V.prepared(metric, q[None])[0].astype(float)
    exact = ((wide[0] - wide[1]) ** 2).sum(1) if metric == "L2" else -(wide[0] @ wide[1])
    assert np.allclose(got, exact, atol=1e-4, rtol=1e-5)


def test_query_validation():
    for v in ([1.0], [1, float("nan"), 2], [1, 2, 3, 4]):
        with pytest.raises(ValueError, match="query"):
            V.check_query("L2", 3, v)
    with pytest.raises(ValueError):
        V.check_query("COSINE", 2, [0, 0])


def test_id_length_counts_utf16_units(spark):
    why = lambda i: one(spark, V.invalid("L2", 1, F.lit(i), V.literal([1])))[0]
    assert why("a" * 256) is None and why("a" * 257) and why("😀" * 128) is None and why("😀" * 129) and why("")
