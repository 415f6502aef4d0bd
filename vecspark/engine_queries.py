"""Queries that run real collections: they create them below the shared folder, write, delete, compact, reopen and search, and
return what is left. The DuckDB SQL says the same of the tables.

Points are the rows of ``embeddings`` (see ``queries``): id 'p' + vec_id, metadata label, kind and odd. The usual changes
after the first upsert are: every fifth point is replaced by its negative, and those with vec_id % 10 = 3 are deleted."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.collection import Collection
from vecspark.config import CollectionConfig, DurabilityConfig, FilterConfig, HnswParams, SearchParams
from vecspark.functions import metadata as M
from vecspark.functions import vector as V
from vecspark.manager import CollectionManager
from vecspark.operators import ann, changes
from vecspark.operators.topk import batch_topk, recall
from vecspark.plans import filters
from vecspark.queries import FILTERS, LAST_SNAPSHOT, PLANNED, _documents, _graphs, _points, _queries, _read
from vecspark.sources.store import shared_root
from vecspark.streaming import sink

DIM = 64
KEEP = DurabilityConfig(compact_above=1.0, index_every=0)
#: Least recall@10 at the default ef, by selection: SIMPLE graphs have few links between groups of points.
FLOORS = {"HEURISTIC": 0.9, "SIMPLE": 0.85}


def _batch(spark: SparkSession, sf_dir: str, which: str = "true", sign: int = 1) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").where(which)
    scale = (sign * (1 + F.col("vec_id") % 7)).cast("float")
    rows = rows.withColumn("kind", F.concat(F.lit("k"), F.col("label"))).withColumn("odd", F.col("vec_id") % 2 == 1)
    return rows.select(F.col("vec_id").alias("pos"), F.concat(F.lit("p"), F.col("vec_id")).alias("id"), F.transform("embedding", lambda x: x * scale).alias("vector"), *M.maps_of(rows, ["label", "kind", "odd"]))


def _filled(spark: SparkSession, sf_dir: str, config: CollectionConfig | None = None, durability: DurabilityConfig = KEEP, root: str | None = None) -> tuple[CollectionManager, Collection]:
    manager = CollectionManager(spark, root or shared_root(spark, "engine"), durability)
    collection = manager.create(config or CollectionConfig.flat("points", DIM))
    collection.upsert(_batch(spark, sf_dir))
    return manager, collection


def _changed(spark: SparkSession, sf_dir: str, collection: Collection) -> None:
    collection.upsert(_batch(spark, sf_dir, "vec_id % 5 = 0", -1))
    collection.delete_frame(_batch(spark, sf_dir, "vec_id % 10 = 3").select("id"))


def _state(collection: Collection) -> DataFrame:
    return collection.points().select("id", "ord", F.get("vector", F.lit(0)).alias("first"), F.col("meta_num")["label"].alias("label"), F.col("meta_str")["kind"].alias("kind"), F.col("meta_bool")["odd"].alias("odd"))


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _filled(spark, sf_dir)
    c.upsert(_batch(spark, sf_dir, "vec_id % 5 = 0", -1))
    return _state(c)


def collection_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _filled(spark, sf_dir)
    _changed(spark, sf_dir, c)
    rows = [(x, c.get(x)) for x in ("p0", "p3", "p5", "p7", "p499", "absent")]
    return spark.createDataFrame([(x, r is not None, r and r.ord, r and r.vector[0], r and r.meta_num["label"]) for x, r in rows], "id string, there boolean, ord long, first float, label double")


def collection_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _filled(spark, sf_dir)
    c.delete_frame(_batch(spark, sf_dir, "vec_id % 10 = 3").select("id").unionByName(spark.createDataFrame([("absent",)], "id string")))
    asked = ["p1", "absent", "p3", "p1"]
    said = spark.createDataFrame([(f"{x} asked {i}", there) for i, (x, there) in enumerate(zip(asked, c.delete(*asked), strict=True))], "id string, there boolean")
    return c.points().select("id", F.lit(True).alias("there")).unionByName(said)


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    manager, c = _filled(spark, sf_dir)
    _changed(spark, sf_dir, c)
    return manager.stats()


def collection_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delete makes over 20 % of the versions dead, so the collection compacts itself."""
    _, c = _filled(spark, sf_dir, durability=DurabilityConfig(index_every=0))
    _changed(spark, sf_dir, c)
    stats = c.stats()
    return c.points().select("id", "ord", F.get("vector", F.lit(0)).alias("first"), F.lit(stats["compactions"]).cast("long").alias("compactions"), F.lit(stats["tombstones"]).cast("long").alias("tombstones"))


def collection_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _filled(spark, sf_dir)
    _changed(spark, sf_dir, c)
    return c.compact().select("ord", "new_ord")


def collection_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, changes after it, and a new manager on the same folder, which verifies every file."""
    root = shared_root(spark, "recover")
    manager, c = _filled(spark, sf_dir, root=root)
    c.snapshot()
    _changed(spark, sf_dir, c)
    manager.close()
    again = CollectionManager(spark, root).get("points")
    again.verify()
    return _state(again)


def collection_small_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight commits, whose segments are merged four by four, and automatic snapshots; whether few folders are left."""
    root = shared_root(spark, "small")
    durability = DurabilityConfig(snapshot_every=0, merge_segments=4, index_every=0)
    c = CollectionManager(spark, root, durability).create(CollectionConfig.flat("points", DIM))
    for i in range(8):
        c.upsert(_batch(spark, sf_dir, f"vec_id % 8 = {i}"))
    again = CollectionManager(spark, root, durability).get("points")
    again.verify()
    return again.points().select("id", "ord", F.lit(len(again.manifest["segments"]) < 4).alias("few_segments"), F.lit(again.last_lsn).alias("last_lsn"))


def collection_auto_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits, each of which takes a snapshot by itself; two snapshots and what they need are kept, and LSNs go on after
    reopening."""
    root = shared_root(spark, "auto")
    durability = DurabilityConfig(snapshot_every=10, keep_snapshots=2, index_every=0)
    c = CollectionManager(spark, root, durability).create(CollectionConfig.flat("points", DIM))
    for i in range(4):
        c.upsert(_batch(spark, sf_dir, f"vec_id % 4 = {i}"))
    c = CollectionManager(spark, root, durability).get("points")
    before = c.last_lsn
    names = c.files.names("points")
    c.upsert([("one more", [1.0] * DIM, None)])
    kept = sum(n.startswith("snapshot-") for n in names)
    return c.points().select("id", "ord", F.lit(kept).alias("snapshots"), F.lit(sum(n.startswith("log-") for n in names) <= kept).alias("log_pruned"), F.lit(c.last_lsn - before).cast("long").alias("lsns"))


def collection_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers and writers of one collection see of each other's work."""
    root = shared_root(spark, "visible")
    _, c = _filled(spark, sf_dir, root=root)
    reader, old = CollectionManager(spark, root).get("points"), CollectionManager(spark, root, KEEP).get("points")
    pinned = reader.points()
    c.delete_frame(_batch(spark, sf_dir, "vec_id % 10 = 3").select("id"))
    rows = [("a reader that was open before the delete", pinned.count()), ("that reader, asked again", reader.points().count()), ("the writer", c.points().count())]
    rows.append(("a reader that opens now", CollectionManager(spark, root, KEEP).get("points").points().count()))
    try:
        old.upsert([("stale", [1.0] * DIM, None)])
    except FileExistsError:
        rows.append(("a writer on the old version fails, and leaves", CollectionManager(spark, root, KEEP).get("points").points().count()))
    c.snapshot()
    rows.append(("the open reader after a snapshot", reader.points().count()))
    return spark.createDataFrame(rows, "who string, live long")


def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each type of event, of the users with such events; one is dropped, and the rest listed after reopening."""
    root, events = shared_root(spark, "list"), _read(spark, sf_dir, "events")
    manager = CollectionManager(spark, root, KEEP)
    for name in sorted(r.event_type for r in events.select("event_type").distinct().collect()):
        rows = events.where(F.col("event_type") == name)
        manager.create(CollectionConfig.flat(name, 1)).upsert(rows.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), *M.maps_of(rows, ["props"])))
    manager.drop("error")
    return CollectionManager(spark, root, KEEP).stats().select("name", "live", "tombstones")


def _events(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").where(which)
    op = F.when(F.col("event_type") == "error", changes.DELETE).otherwise(changes.UPSERT)
    return rows.select(F.col("event_id").alias("pos"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.when(op == changes.UPSERT, F.array(F.col("value").cast("float"))).alias("vector"), *M.maps_of(rows, ["event_type"]))


def _users(collection: Collection) -> DataFrame:
    return collection.points().select("id", F.get("vector", F.lit(0)).alias("value"), F.col("meta_str")["event_type"].alias("event_type"))


def snapshot_plus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as changes: those up to LAST_SNAPSHOT, a snapshot, the rest in one commit, and reopening."""
    root = shared_root(spark, "events")
    c = CollectionManager(spark, root).create(CollectionConfig.flat("users", 1))
    c.apply(_events(spark, sf_dir, f"event_id <= {LAST_SNAPSHOT}"))
    c.snapshot()
    c.apply(_events(spark, sf_dir, f"event_id > {LAST_SNAPSHOT}"))
    return _users(CollectionManager(spark, root).get("users"))


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as a stream of files, each micro-batch one commit."""
    root, source = shared_root(spark, "stream"), shared_root(spark, "stream-in")
    c = CollectionManager(spark, root).create(CollectionConfig.flat("users", 1))
    rows = _events(spark, sf_dir, "true")
    rows.coalesce(1).write.parquet(source)
    sink.start(c, spark.readStream.schema(rows.schema).parquet(source), shared_root(spark, "stream-at"), availableNow=True).awaitTermination()
    return _users(c)


SEARCHED = {"none": None, **PLANNED}


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an exact collection for the vector of p5, without and with filters, and the strategies that ran."""
    _, c = _filled(spark, sf_dir)
    query, out = c.get("p5").vector, []
    for name, where in SEARCHED.items():
        found = c.search(query, 5, where=where)
        hits = [(i + 1, h.id, h.score, h.metadata["kind"]) for i, h in enumerate(found.hits)] or [(0, None, None, None)]
        out += [(name, found.strategy, found.selectivity, *h) for h in hits]
    return spark.createDataFrame(out, "filter string, strategy string, selectivity double, rank int, id string, score float, kind string")


def collection_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth point as a query, over those that a filter and a further predicate on ordinals allow."""
    _, c = _filled(spark, sf_dir)
    queries = _batch(spark, sf_dir, "vec_id % 50 = 0").select(F.col("pos").alias("qid"), "vector")
    return c.search_many(queries, 5, where={"field": "odd", "eq": True}, also=F.col("ord") % 3 != 0)[0].select("qid", "rank", "id", "score")


def scan_of_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below two percent a collection with graphs scans the matches, so its hits are exact, and may be fewer than k."""
    _, c = _filled(spark, sf_dir, CollectionConfig.with_hnsw("points", DIM))
    c.build_index()
    rows, chosen = c.search_frame(c.get("p5").vector, 12, also=F.col("ord") % 100 == 7)
    return rows.select("rank", "id", "score", F.lit(chosen.strategy).alias("strategy"))


def knn_fewer_than_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return batch_topk(points.where("ord % 500 < 3"), _queries(points), 10_000)


def _reached(got: DataFrame, truth: DataFrame, floor: float = FLOORS["HEURISTIC"]) -> bool:
    return recall(got, truth, 10).first().recall >= floor


def hnsw_recall_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether graphs of each metric and selection reach their floor over every fiftieth point."""
    rows = []
    for metric in ("L2", "DOT", "COSINE"):
        points = _points(spark, sf_dir, metric)
        queries = _queries(points)
        truth = batch_topk(points, queries, 10, metric)
        for selection in ("SIMPLE", "HEURISTIC"):
            params = HnswParams(selection=selection)
            index = ann.build_index(points, metric, params, 1000)
            rows.append((metric, selection, _reached(ann.search_index(index, queries, 10, metric=metric, params=params), truth, FLOORS[selection])))
    return spark.createDataFrame(rows, "metric string, selection string, reached boolean")


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back, where several actions need them."""
    path = shared_root(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def hnsw_filter_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches among a share of the points reach their floor over every fiftieth point, and return only such points.
    The graphs are built once for all shares."""
    rows, (points, index, queries) = [], _graphs(spark, sf_dir, 1000)
    index = _kept(index, "floors")
    shards = max(1, -(-points.count() // 1000))
    for share in (5, 10, 30, 60):
        eligible = points.where(F.col("ord") % 100 < share)
        got = _kept(ann.search_index(index, queries, 10, min(FilterConfig().max_ef, 64 * -(-100 // share)), eligible.select("ord"), shards), "hits")
        rows.append((share, _reached(got, batch_topk(eligible, queries, 10)), got.join(eligible, "ord", "left_anti").isEmpty()))
    return spark.createDataFrame(rows, "share int, reached boolean, only_eligible boolean")


def hnsw_graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every graph: list lengths, no links to a node itself or twice, all points on layer 0, higher layers inside
    lower ones, and the same graph when it is built again."""
    points = _points(spark, sf_dir)
    params = HnswParams(m=8)
    links = ann.graph_rows(ann.build_index(points, "L2", params, 1000)).cache()
    again = ann.graph_rows(ann.build_index(points, "L2", params, 1000))
    most = F.when(F.col("layer") == 0, params.m0).otherwise(params.m)
    found = links.agg(
        F.bool_and(F.size("neighbours") <= most).alias("at most so many neighbours"), F.bool_and(~F.array_contains("neighbours", F.col("node"))).alias("no node is its own neighbour"),
        F.bool_and(F.size(F.array_distinct("neighbours")) == F.size("neighbours")).alias("no neighbour twice"), F.bool_and(F.col("layer") <= F.col("level")).alias("layers up to the level")).first().asDict()
    found["all points on layer 0"] = links.where("layer = 0").select(F.col("node").alias("ord")).exceptAll(points.select("ord")).isEmpty() and links.where("layer = 0").count() == points.count()
    found["built again it is the same"] = links.exceptAll(again).isEmpty()
    links.unpersist()
    return spark.createDataFrame(list(found.items()), "rule string, holds boolean")


def collection_index_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, and whether all live points are in graphs, as a collection gets graphs by itself, grows, is reopened, loses points
    and is compacted."""
    root = shared_root(spark, "life")
    durability = DurabilityConfig(compact_above=1.0, index_every=100)
    c = CollectionManager(spark, root, durability).create(CollectionConfig.with_hnsw("points", DIM))
    queries = _batch(spark, sf_dir, "vec_id % 50 = 0").select(F.col("pos").alias("qid"), "vector")
    rows = []

    def look(step: str, collection: Collection) -> None:
        truth = batch_topk(collection.points().select("ord", "vector"), queries, 10)
        got, chosen = collection.search_many(queries, 10, SearchParams(ef=128))
        indexed = sum(x["rows"] for x in collection.manifest["indexes"])
        rows.append((step, chosen.strategy, len(collection.manifest["indexes"]), indexed == collection.manifest["live"], _reached(got, truth)))

    c.upsert(_batch(spark, sf_dir, "vec_id % 2 = 0"))
    look("first", c)
    c.upsert(_batch(spark, sf_dir, "vec_id % 2 = 1"))
    look("grown", c)
    c = CollectionManager(spark, root, durability).get("points")
    c.delete_frame(_batch(spark, sf_dir, "vec_id % 10 = 3").select("id"))
    look("deleted", c)
    c.compact()
    look("compacted", c)
    return spark.createDataFrame(rows, "step string, strategy string, graphs int, all_indexed boolean, reached boolean")


def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of error that each wrong call raises; what failed leaves nothing behind."""
    manager, c = _filled(spark, sf_dir, CollectionConfig.flat("points", DIM, "COSINE"))
    good = c.get("p1").vector
    calls: dict[str, Callable] = {
        "create a name again": lambda: manager.create(CollectionConfig.flat("POINTS", 3)), "get what is not there": lambda: manager.get("none"), "drop what is not there": lambda: manager.drop("none"),
        "a name with a blank": lambda: CollectionConfig.flat("a b", 3), "no components": lambda: CollectionConfig.flat("a", 0), "an unknown metric": lambda: CollectionConfig.flat("a", 1, "L3"), "m of 1": lambda: HnswParams(m=1),
        "k of 0": lambda: c.search(good, 0), "k over 10000": lambda: c.search(good, 10_001), "ef over 10000": lambda: c.search(good, 1, SearchParams(ef=10_001)), "a short query": lambda: c.search(good[:5], 1),
        "a zero query under COSINE": lambda: c.search([0.0] * DIM, 1), "an infinite component": lambda: c.upsert([("new", [float("inf")] * DIM, None)]), "an empty id": lambda: c.upsert([("new", good, None), ("", good, None)]),
        "metadata with null": lambda: c.upsert([("new", good, {"a": None})]), "a filter without a field": lambda: filters.parse({"eq": 1}), "a filter with two operators": lambda: filters.parse({"field": "a", "eq": 1, "in": [1]}), "an empty in": lambda: filters.parse({"field": "a", "in": []}),
        "a range of strings": lambda: filters.parse({"field": "a", "range": {"gt": "b"}}),
        "vectors of two lengths": lambda: spark.range(1).select(V.distance("L2", V.literal([1.0, 2.0]), V.literal([1.0])).alias("x")).collect(), "nothing wrong": lambda: c.get("new")}
    rows = []
    for name, call in calls.items():
        try:
            rows.append((name, "none" if call() is None else "a result"))
        except Exception as e:  # noqa: BLE001  the kind of error is the result
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "attempt string, error string")


def filter_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain evaluator, row by row, on two filters, over all documents."""
    nested, strict = filters.parse(FILTERS["filter_nested"]), filters.parse(FILTERS["filter_in_mixed"])

    def judged(batches):
        for rows in batches:
            fields = [M.joined(*(dict(m) for m in x)) for x in zip(rows["meta_str"], rows["meta_num"], rows["meta_bool"], strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "nested": [nested.matches(f) for f in fields], "strict": [strict.matches(f) for f in fields]})

    return _documents(spark, sf_dir).mapInPandas(judged, "doc_id long, nested boolean, strict boolean")


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as JSON and read back."""

    def coded(batches):
        for rows in batches:
            texts = [M.to_json(M.joined(*(dict(m) for m in x))) for x in zip(rows["meta_str"], rows["meta_num"], rows["meta_bool"], strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "json": texts, "same": [M.to_json(M.from_json(t)) == t for t in texts]})

    return _documents(spark, sf_dir).mapInPandas(coded, "doc_id long, json string, same boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (collection_upsert, collection_get, collection_delete, collection_stats, collection_compaction, collection_remap, collection_recover, collection_small_commits, collection_auto_snapshots, collection_visibility, list_collections, snapshot_plus_log, stream_changes,
             collection_search, collection_search_many, scan_of_few, knn_fewer_than_k, hnsw_recall_floors, hnsw_filter_floors, hnsw_graph_rules, collection_index_life, engine_errors, filter_evaluator, metadata_json)
    return {f.__name__: f for f in named}


_SCALED = "scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x * (1 + vec_id % 7)::float) AS vector, label, row_number() OVER (ORDER BY vec_id) - 1 AS nth, count(*) OVER () AS n FROM embeddings)"
#: All points after the usual changes, with those deleted.
_AFTER = (f"WITH {_SCALED}, again AS (SELECT vec_id, n + row_number() OVER (ORDER BY vec_id) - 1 AS later FROM scaled WHERE vec_id % 5 = 0), "
          "state AS (SELECT 'p' || vec_id AS id, vec_id, coalesce(later, nth) AS ord, CASE WHEN later IS NULL THEN vector[1] ELSE -vector[1] END AS first, label::double AS label, 'k' || label AS kind, vec_id % 2 = 1 AS odd, n FROM scaled LEFT JOIN again USING (vec_id))")


def oracle_sql(l2: Callable[[str, str], str], docs: str, sql_filters: dict[str, str]) -> dict[str, str]:
    out = {}
    columns = "id, ord, first, label, kind, odd"
    live = "vec_id % 10 <> 3"
    out["collection_upsert"] = f"{_AFTER} SELECT {columns} FROM state"
    out["collection_get"] = f"{_AFTER}, asked(id) AS (VALUES ('p0'), ('p3'), ('p5'), ('p7'), ('p499'), ('absent')) SELECT asked.id, state.id IS NOT NULL AS there, ord, first, label FROM asked LEFT JOIN (SELECT * FROM state WHERE {live}) state USING (id)"
    out["collection_delete"] = "SELECT 'p' || vec_id AS id, true AS there FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id <> 1 UNION ALL VALUES ('p1 asked 0', true), ('absent asked 1', false), ('p3 asked 2', false), ('p1 asked 3', false)"
    out["collection_stats"] = (f"{_AFTER}, c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 5 = 0) AS replaced, count(*) FILTER (vec_id % 10 = 3) AS gone FROM state) "
                               "SELECT 'points' AS name, 64::int AS dim, 'L2' AS metric, 'FLAT' AS index_type, n - gone AS live, replaced + gone AS tombstones, (n + replaced) * 256 AS memory_bytes, 0::bigint AS compactions, 1 + n + replaced + gone AS last_lsn FROM c")
    out["collection_compaction"] = f"{_AFTER} SELECT id, row_number() OVER (ORDER BY ord) - 1 AS ord, first, 1::bigint AS compactions, 0::bigint AS tombstones FROM state WHERE {live}"
    out["collection_remap"] = f"{_AFTER} SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS new_ord FROM state WHERE {live}"
    out["collection_recover"] = f"{_AFTER} SELECT {columns} FROM state WHERE {live}"
    out["collection_small_commits"] = "SELECT 'p' || vec_id AS id, row_number() OVER (ORDER BY vec_id % 8, vec_id) - 1 AS ord, true AS few_segments, 1 + count(*) OVER () AS last_lsn FROM embeddings"
    out["collection_auto_snapshots"] = ("SELECT id, row_number() OVER (ORDER BY part, vec_id) - 1 AS ord, 2::int AS snapshots, true AS log_pruned, 1::bigint AS lsns FROM (SELECT 'p' || vec_id AS id, vec_id % 4 AS part, vec_id FROM embeddings UNION ALL SELECT 'one more', 4, 0)")
    all_, left = "(SELECT count(*) FROM embeddings)", "(SELECT count(*) FROM embeddings WHERE vec_id % 10 <> 3)"
    out["collection_visibility"] = (f"SELECT * FROM (VALUES ('a reader that was open before the delete', {all_}), ('that reader, asked again', {all_}), ('the writer', {left}), ('a reader that opens now', {left}), "
                                    f"('a writer on the old version fails, and leaves', {left}), ('the open reader after a snapshot', {all_})) t(who, live)")
    out["list_collections"] = "SELECT event_type AS name, count(DISTINCT user_id) AS live, count(*) - count(DISTINCT user_id) AS tombstones FROM events WHERE event_type <> 'error' GROUP BY 1"
    users = "SELECT user_id::varchar AS id, value::float AS value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"
    out["snapshot_plus_log"] = out["stream_changes"] = users
    points = "points AS (SELECT 'p' || vec_id AS id, vec_id, label, vec_id % 2 = 1 AS odd, vector FROM scaled)"
    tests = ["true", "label = 1", "label IN (1, 2, 3)", "label < 0.5", "label = 99"]
    parts = " UNION ALL ".join(f"SELECT '{name}' AS filter, {i} AS nth, p.*, {test} AS matches FROM points p" for i, (name, test) in enumerate(zip(SEARCHED, tests, strict=True)))
    out["collection_search"] = (f"WITH {_SCALED}, {points}, parts AS ({parts}), shares AS (SELECT filter, nth, count(*) FILTER (matches) / count(*) AS selectivity FROM parts GROUP BY ALL), "
                                f"hits AS (SELECT b.filter, b.id, b.label, {l2('b.vector', 'q.vector')} AS score, row_number() OVER (PARTITION BY b.filter ORDER BY {l2('b.vector', 'q.vector')}, b.vec_id) AS rank FROM parts b, points q WHERE q.vec_id = 5 AND b.matches) "
                                "SELECT filter, CASE WHEN nth = 0 THEN 'UNFILTERED' WHEN selectivity = 0 THEN 'NO_MATCH' WHEN selectivity < 0.02 THEN 'EXACT_SCAN' ELSE 'FILTERED_INDEX' END AS strategy, selectivity::double AS selectivity, coalesce(rank, 0)::int AS rank, id, score, 'k' || label AS kind "
                                "FROM shares LEFT JOIN (SELECT * FROM hits WHERE rank <= 5) hits USING (filter)")
    out["collection_search_many"] = (f"WITH {_SCALED}, {points}, hits AS (SELECT q.vec_id AS qid, b.id, {l2('b.vector', 'q.vector')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {l2('b.vector', 'q.vector')}, b.vec_id) AS rank "
                                     "FROM points b, points q WHERE q.vec_id % 50 = 0 AND b.odd AND b.vec_id % 3 <> 0) SELECT qid, rank::int AS rank, id, score FROM hits WHERE rank <= 5")
    out["scan_of_few"] = f"WITH {_SCALED}, {points} SELECT (row_number() OVER (ORDER BY {l2('b.vector', 'q.vector')}, b.vec_id))::int AS rank, b.id, {l2('b.vector', 'q.vector')} AS score, 'EXACT_SCAN' AS strategy FROM points b, points q WHERE q.vec_id = 5 AND b.vec_id % 100 = 7 ORDER BY rank LIMIT 12"
    out["knn_fewer_than_k"] = f"WITH {_SCALED}, {points} SELECT q.vec_id AS qid, (row_number() OVER (PARTITION BY q.vec_id ORDER BY {l2('b.vector', 'q.vector')}, b.vec_id))::int AS rank, b.vec_id AS ord, {l2('b.vector', 'q.vector')} AS score FROM points b, points q WHERE q.vec_id % 50 = 0 AND b.vec_id % 500 < 3"
    out["hnsw_recall_floors"] = "SELECT metric, selection, true AS reached FROM (VALUES ('L2'), ('DOT'), ('COSINE')) a(metric), (VALUES ('SIMPLE'), ('HEURISTIC')) b(selection)"
    out["hnsw_filter_floors"] = "SELECT share::int AS share, true AS reached, true AS only_eligible FROM (VALUES (5), (10), (30), (60)) t(share)"
    out["hnsw_graph_rules"] = "SELECT rule, true AS holds FROM (VALUES ('at most so many neighbours'), ('no node is its own neighbour'), ('no neighbour twice'), ('layers up to the level'), ('all points on layer 0'), ('built again it is the same')) t(rule)"
    out["collection_index_life"] = "SELECT step, 'UNFILTERED' AS strategy, graphs::int AS graphs, all_indexed, true AS reached FROM (VALUES ('first', 1, true), ('grown', 2, true), ('deleted', 2, false), ('compacted', 1, true)) t(step, graphs, all_indexed)"
    wrong = {"create a name again": "CollectionExistsError", "get what is not there": "CollectionNotFoundError", "drop what is not there": "CollectionNotFoundError", "nothing wrong": "none", "vectors of two lengths": "SparkRuntimeException"}
    bad = ["a name with a blank", "no components", "an unknown metric", "m of 1", "k of 0", "k over 10000", "ef over 10000", "a short query", "a zero query under COSINE", "an infinite component", "an empty id", "metadata with null", "a filter without a field", "a filter with two operators", "an empty in", "a range of strings"]
    out["engine_errors"] = "SELECT attempt, error FROM (VALUES " + ", ".join(f"('{a}', '{e}')" for a, e in (wrong | dict.fromkeys(bad, "ValueError")).items()) + ") t(attempt, error)"
    out["filter_evaluator"] = f"WITH {docs} SELECT doc_id, coalesce({sql_filters['filter_nested']}, false) AS nested, coalesce({sql_filters['filter_in_mixed']}, false) AS strict FROM docs"
    out["metadata_json"] = (f"WITH {docs} SELECT doc_id, '{{' || list_aggregate(list_filter(['\"lang\": ' || '\"' || lang || '\"', '\"n_chars\": ' || n_chars::double, '\"quality\": ' || quality::double, '\"source\": ' || '\"' || source || '\"', '\"toxic\": ' || (toxic = 1)], lambda x: x IS NOT NULL), 'string_agg', ', ') || '}}' AS json, true AS same FROM docs")
    return out
