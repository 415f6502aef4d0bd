"""Queries over the test tables, one or more for each operator, and the DuckDB SQL that gives the same rows.

``embeddings`` are points with ``ord = vec_id``; vectors are scaled by 1 + vec_id % 7, so that the metrics differ.
``events`` are a change log: lsn is event_id, id is user_id, and 'error' deletes. ``documents`` carry metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.config import HnswParams
from vecspark.functions import metadata as M
from vecspark.functions import vector as V
from vecspark.operators import ann, changes
from vecspark.operators.topk import batch_topk, exact_topk, merge_topk, pairwise, recall
from vecspark.plans import filters
from vecspark.plans.planner import plan_column

LAST_SNAPSHOT = 6000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str, metric: str = "L2") -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    scale = (1 + F.col("vec_id") % 7).cast("float")
    return rows.select(F.col("vec_id").alias("ord"), V.prepare(metric, F.transform("embedding", lambda x: x * scale)).alias("vector"), *M.maps_of(rows, ["label"]))


def _query(points: DataFrame, ord_: int = 0) -> list[float]:
    return points.where(F.col("ord") == ord_).first().vector


def _queries(points: DataFrame) -> DataFrame:
    """Every fiftieth point as a query, over the whole table."""
    return points.where(F.col("ord") % 50 == 0).select(F.col("ord").alias("qid"), "vector")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.withColumn("toxic", F.col("toxic") == 1).select("doc_id", *M.maps_of(rows.withColumn("toxic", F.col("toxic") == 1), ["lang", "source", "n_chars", "quality", "toxic"]))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", changes.DELETE).otherwise(changes.UPSERT)
    return rows.select(F.col("event_id").alias("lsn"), op.alias("op"), F.col("user_id").alias("id"), "value", "props")


def _knn(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir, metric)
        return exact_topk(points, _query(points), 10, metric)

    return query


def _knn_batch(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir, metric)
        return batch_topk(points, _queries(points), 10, metric)

    return query


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "COSINE").select("ord", F.posexplode("vector").alias("at", "x"))


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return pairwise(points, _queries(points)).select("qid", "ord", "l2", F.col("dot").alias("neg_dot"))


def knn_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return exact_topk(points, _query(points, 3), 10).join(points.select("ord", F.col("meta_num")["label"].alias("label")), "ord")


def knn_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    twice = points.unionByName(points.withColumn("ord", F.col("ord") + 10_000))
    return exact_topk(twice, _query(points), 9)


def knn_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return exact_topk(points.where("ord % 3 <> 1"), _query(points, 1), 10)


FILTERS = {
    "filter_eq": {"field": "lang", "eq": "de"},
    "filter_in": {"field": "source", "in": ["src1", "src3", "src7"]},
    "filter_in_mixed": {"field": "quality", "in": ["0", 0, True]},
    "filter_range": {"field": "n_chars", "range": {"gte": 500, "lt": 2000}},
    "filter_range_empty": {"field": "n_chars", "range": {"gt": 5000, "lte": 5000}},
    "filter_bool": {"field": "toxic", "eq": True},
    "filter_and": {"and": [{"field": "lang", "eq": "en"}, {"field": "n_chars", "range": {"gt": 3000}}]},
    "filter_or": {"or": [{"field": "lang", "eq": "fr"}, {"field": "quality", "eq": 0}]},
    "filter_nested": {"and": [{"or": [{"field": "lang", "in": ["fr", "es"]}, {"field": "quality", "range": {"lte": 0}}]}, {"field": "n_chars", "range": {"gte": 200, "lte": 8000}}, {"field": "source", "in": ["src0", "src1", "src2", "src3", "src4", "src5"]}]},
    "filter_type_strict": {"field": "n_chars", "eq": "500"},
}
_SQL_FILTERS = {
    "filter_eq": "lang = 'de'",
    "filter_in": "source IN ('src1', 'src3', 'src7')",
    "filter_in_mixed": "quality = 0",
    "filter_range": "n_chars >= 500 AND n_chars < 2000",
    "filter_range_empty": "false",
    "filter_bool": "toxic = 1",
    "filter_and": "lang = 'en' AND n_chars > 3000",
    "filter_or": "lang = 'fr' OR quality = 0",
    "filter_nested": "(lang IN ('fr', 'es') OR quality <= 0) AND n_chars BETWEEN 200 AND 8000 AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')",
    "filter_type_strict": "false",
}


def _filter(name: str):
    return lambda spark, sf_dir: _documents(spark, sf_dir).where(filters.parse(FILTERS[name]).column()).select("doc_id")


def metadata_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _documents(spark, sf_dir)
    return maps.select("doc_id", F.col("meta_str")["lang"].alias("lang"), F.col("meta_num")["quality"].alias("quality"), F.col("meta_bool")["toxic"].alias("toxic"), F.size("meta_str").alias("strings"), F.size("meta_num").alias("numbers"))


def filtered_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return exact_topk(points.where(filters.parse({"field": "label", "in": [1, 3]}).column() & (F.col("ord") >= 100)), _query(points, 5), 10)


def filtered_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    eligible = points.where(filters.parse({"field": "label", "range": {"lt": 5}}).column())
    return batch_topk(eligible, _queries(points), 5)


PLANNED = {"label is 1": {"field": "label", "eq": 1}, "label is 1, 2 or 3": {"field": "label", "in": [1, 2, 3]}, "label under 0.5": {"field": "label", "range": {"lt": 0.5}}, "label is 99": {"field": "label", "eq": 99}}


def plan_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    counts = points.agg(F.count("*").alias("live"), *[F.count_if(filters.parse(f).column()).alias(f"m{i}") for i, f in enumerate(PLANNED.values())], F.count_if(F.col("ord") < 5).alias("few"))
    listed = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(f"m{i}").alias("matches")) for i, name in enumerate(PLANNED)], F.struct(F.lit("first five").alias("filter"), F.col("few").alias("matches")))
    rows = counts.select("live", F.inline(listed))
    return rows.select("filter", "matches", "live", *plan_column(F.col("matches"), F.col("live"), 10, 0, 64))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(_log(spark, sf_dir), "value", "props")


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(_log(spark, sf_dir).where("id = 7 or id = 8 or id = 100000"), "value")


def delete_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    live = changes.latest(log)
    return log.select("id").distinct().join(live.select("id", F.lit(True).alias("live")), "id", "left").select("id", F.coalesce("live", F.lit(False)).alias("live"))


def tombstone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.counters(_log(spark, sf_dir)).withColumn("needs_compaction", changes.needs_compaction(F.col("tombstones"), F.col("stored")))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.with_ordinals(_log(spark, sf_dir)).select("lsn", "id", "ord")


def compaction_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = changes.with_ordinals(_log(spark, sf_dir)).select("lsn", "ord")
    live = changes.latest(_log(spark, sf_dir)).select("lsn", F.lit(True).alias("live"))
    return changes.remap(numbered.join(live, "lsn", "left").select("ord", F.coalesce("live", F.lit(False)).alias("live")))


def last_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.last_of_batch(_log(spark, sf_dir).select(F.col("lsn").alias("pos"), "id", "value"))


def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    broken = (
        F.when(n % 10 == 1, F.slice("embedding", 1, 63))
        .when(n % 10 == 2, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan")).cast("float")).otherwise(x)))
        .when(n % 10 == 3, F.transform("embedding", lambda x, i: F.when(i == 6, F.lit(float("-inf")).cast("float")).otherwise(x)))
        .when(n % 10 == 4, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
        .otherwise(F.col("embedding")))
    point_id = F.when(n % 10 == 5, "").otherwise(n.cast("string"))
    return rows.select("vec_id", V.invalid("COSINE", 64, point_id, broken).alias("why"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    ids = lambda f: documents.where(filters.parse(f).column()).select("doc_id")
    either, both, rest = ids(FILTERS["filter_or"]), ids(FILTERS["filter_and"]), ids(FILTERS["filter_range"])
    return either.union(both).distinct().exceptAll(rest.distinct()).select("doc_id")


def _graphs(spark: SparkSession, sf_dir: str, shard_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = _points(spark, sf_dir)
    return points, ann.build_index(points, "L2", HnswParams(), shard_rows), _queries(points)


def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index, queries = _graphs(spark, sf_dir, 1000)
    return ann.search_index(index, queries, 10)


def hnsw_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, index, queries = _graphs(spark, sf_dir, 1000)
    return ann.search_index(index, queries, 10, 256, points.where(filters.parse({"field": "label", "in": [1, 2, 3]}).column()).select("ord"), max(1, -(-points.count() // 1000)))


def hnsw_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.graph_rows(_graphs(spark, sf_dir, 1000)[1])


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, index, queries = _graphs(spark, sf_dir, 1000)
    return recall(ann.search_index(index, queries, 10), batch_topk(points, queries, 10), 10)


def recall_of_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    queries = _queries(points)
    return recall(batch_topk(points, queries, 10), merge_topk(pairwise(points, queries, ("L2",)).select("qid", "ord", F.col("l2").alias("score")), 10), 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"knn_{m.lower()}": _knn(m) for m in ("L2", "DOT", "COSINE")} | {f"knn_batch_{m.lower()}": _knn_batch(m) for m in ("L2", "DOT", "COSINE")}
    out |= {name: _filter(name) for name in FILTERS}
    named = (vector_normalize, pairwise_distance, knn_with_metadata, knn_tie_break, knn_after_delete, metadata_maps, filtered_knn_exact, filtered_knn_batch, plan_selectivity, upsert_latest, point_get,
             delete_then_live, tombstone_stats, ordinals, compaction_remap, last_of_batch, validate_vectors, set_operations, hnsw_knn, hnsw_filtered, hnsw_graph, recall_at_k, recall_of_exact)
    return out | {f.__name__: f for f in named}


_POINTS = "points AS (SELECT vec_id AS ord, list_transform(embedding, lambda x: x * (1 + vec_id % 7)::float) AS vector, label FROM embeddings)"
_NORM = "sqrt(list_reduce(list_transform(vector, lambda x: x::double * x::double), lambda a, b: a + b))"
_UNIT = f"{_POINTS}, unit AS (SELECT ord, list_transform(list_zip(vector, list_resize([]::double[], len(vector), {_NORM})), lambda z: (z[1]::double / z[2])::float) AS vector, label FROM points)"
_DOCS = "docs AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
_EVENTS = "log AS (SELECT event_id AS lsn, user_id AS id, event_type = 'error' AS gone, value, props FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS rn FROM log)"


def _l2(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda m, n: (m + n)::float)"


def _dot(a: str, b: str) -> str:
    return f"0::float - list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda m, n: (m + n)::float)"


def oracle_sql() -> dict[str, str]:
    out = {}
    for metric, cte, rows, score in (("l2", _POINTS, "points", _l2), ("dot", _POINTS, "points", _dot), ("cosine", _UNIT, "unit", _dot)):
        out[f"knn_{metric}"] = f"WITH {cte} SELECT b.ord, {score('b.vector', 'q.vector')} AS score FROM {rows} b, {rows} q WHERE q.ord = 0 ORDER BY score, b.ord LIMIT 10"
        out[f"knn_batch_{metric}"] = (f"WITH {cte}, scored AS (SELECT q.ord AS qid, b.ord, {score('b.vector', 'q.vector')} AS score FROM {rows} b, {rows} q WHERE q.ord % 50 = 0), "
                                      "ranked AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score, ord))::int AS rank FROM scored) SELECT qid, rank, ord, score FROM ranked WHERE rank <= 10")
    out |= {name: f"WITH {_DOCS} SELECT doc_id FROM docs WHERE {test}" for name, test in _SQL_FILTERS.items()}
    out["vector_normalize"] = f"WITH {_UNIT} SELECT ord, (i - 1)::int AS at, vector[i] AS x FROM unit, range(1, 65) t(i)"
    out["pairwise_distance"] = f"WITH {_POINTS} SELECT q.ord AS qid, b.ord, {_l2('b.vector', 'q.vector')} AS l2, {_dot('b.vector', 'q.vector')} AS neg_dot FROM points b, points q WHERE q.ord % 50 = 0"
    knn = lambda q, where, k=10, extra="": f"WITH {_POINTS} SELECT b.ord, {_l2('b.vector', 'q.vector')} AS score{extra} FROM points b, points q WHERE q.ord = {q} AND {where} ORDER BY score, b.ord LIMIT {k}"
    out["knn_with_metadata"] = knn(3, "true", extra=", b.label::double AS label")
    out["knn_tie_break"] = f"WITH {_POINTS}, twice AS (SELECT ord, vector FROM points UNION ALL SELECT ord + 10000, vector FROM points) SELECT b.ord, {_l2('b.vector', 'q.vector')} AS score FROM twice b, points q WHERE q.ord = 0 ORDER BY score, b.ord LIMIT 9"
    out["knn_after_delete"] = knn(1, "b.ord % 3 <> 1")
    out["filtered_knn_exact"] = knn(5, "b.label IN (1, 3) AND b.ord >= 100")
    out["filtered_knn_batch"] = (f"WITH {_POINTS}, scored AS (SELECT q.ord AS qid, b.ord, {_l2('b.vector', 'q.vector')} AS score FROM points b, points q WHERE q.ord % 50 = 0 AND b.label < 5), "
                                 "ranked AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score, ord))::int AS rank FROM scored) SELECT qid, rank, ord, score FROM ranked WHERE rank <= 5")
    out["metadata_maps"] = f"WITH {_DOCS} SELECT doc_id, lang, quality::double AS quality, toxic = 1 AS toxic, ((lang IS NOT NULL)::int + (source IS NOT NULL)::int)::int AS strings, ((n_chars IS NOT NULL)::int + (quality IS NOT NULL)::int)::int AS numbers FROM docs"
    tests = ["label = 1", "label IN (1, 2, 3)", "label < 0.5", "label = 99", "vec_id < 5"]
    union = " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) FILTER ({test}) AS matches, count(*) AS live FROM embeddings" for name, test in zip([*PLANNED, "first five"], tests, strict=True))
    out["plan_selectivity"] = (f"WITH c AS ({union}) SELECT filter, matches, live, CASE WHEN matches = 0 THEN 'NO_MATCH' WHEN matches / live < 0.02 THEN 'EXACT_SCAN' ELSE 'FILTERED_INDEX' END AS strategy, "
                               "CASE WHEN matches = 0 THEN 0.0::double ELSE matches / live END AS selectivity, (CASE WHEN matches = 0 OR matches / live < 0.02 THEN 0 ELSE least(4096, 64 * ceil(live / matches)) END)::bigint AS ef FROM c")
    out["upsert_latest"] = f"WITH {_EVENTS} SELECT id, lsn, value, props FROM ranked WHERE rn = 1 AND NOT gone"
    out["point_get"] = f"WITH {_EVENTS} SELECT id, lsn, value FROM ranked WHERE rn = 1 AND NOT gone AND id IN (7, 8, 100000)"
    out["delete_then_live"] = f"WITH {_EVENTS} SELECT id, NOT gone AS live FROM ranked WHERE rn = 1"
    out["tombstone_stats"] = f"WITH {_EVENTS}, c AS (SELECT count(*) FILTER (NOT gone) AS stored, count(*) FILTER (rn = 1 AND NOT gone) AS live FROM ranked) SELECT stored, live, stored - live AS tombstones, CASE WHEN stored > 0 THEN (stored - live) / stored ELSE 0 END AS tombstone_ratio, (stored - live) / stored > 0.20 AS needs_compaction FROM c"
    out["ordinals"] = f"WITH {_EVENTS} SELECT lsn, id, row_number() OVER (ORDER BY lsn) - 1 AS ord FROM log WHERE NOT gone"
    out["compaction_remap"] = f"WITH {_EVENTS}, n AS (SELECT row_number() OVER (ORDER BY lsn) - 1 AS ord, rn = 1 AS live FROM ranked WHERE NOT gone) SELECT ord, CASE WHEN live THEN row_number() OVER (PARTITION BY live ORDER BY ord) - 1 ELSE -1 END AS new_ord FROM n"
    out["last_of_batch"] = "SELECT user_id AS id, max(event_id) AS pos, arg_max(value, event_id) AS value FROM events GROUP BY user_id"
    out["validate_vectors"] = """SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN 'vector of ' || vec_id || ' has dim 63, expected 64' WHEN 2 THEN 'vector of ' || vec_id || ' has a component that is not finite'
        WHEN 3 THEN 'vector of ' || vec_id || ' has a component that is not finite' WHEN 4 THEN 'vector of ' || vec_id || ' is zero, which COSINE cannot use' WHEN 5 THEN 'an id needs 1 to 256 characters: ' END AS why FROM embeddings"""
    out["set_operations"] = f"WITH {_DOCS} SELECT DISTINCT doc_id FROM docs WHERE (({_SQL_FILTERS['filter_or']}) OR ({_SQL_FILTERS['filter_and']})) AND NOT coalesce({_SQL_FILTERS['filter_range']}, false)"
    out["recall_of_exact"] = "SELECT 1.0::double AS recall"
    return out
