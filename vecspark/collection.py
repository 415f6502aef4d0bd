"""A named set of points with a fixed dimension, metric and index: changes, searches, snapshots.

State is an immutable version: a snapshot and the change log after it. A reader pins the version it starts from; one writer
at a time publishes the next. Ordinals follow the order of writes and break ties between equal distances."""

from __future__ import annotations

import math
import threading
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.config import MAX_EF, MAX_K, CollectionConfig, DurabilityConfig, FilterConfig, SearchParams
from vecspark.errors import LogCorruptedError, SnapshotCorruptedError
from vecspark.functions import metadata as M
from vecspark.functions import vector as V
from vecspark.operators import ann, changes
from vecspark.operators.topk import batch_topk, exact_topk, merge_topk
from vecspark.plans import filters
from vecspark.plans.planner import Plan, plan
from vecspark.sources.store import CHECKED, LOG, POINTS, Files, Manifests

MAPS = ["meta_str", "meta_num", "meta_bool"]
#: Ids up to this many are looked up by a filter that reaches the Parquet scan; snapshots are sorted by id.
FEW_IDS = 1000
#: Graphs over successive ranges of ordinals that a collection has at most, before one over all takes their place.
MOST_INDEXES = 8
BATCH = "pos long, id string, vector array<float>, meta_str map<string,string>, meta_num map<string,double>, meta_bool map<string,boolean>"


@dataclass(frozen=True)
class SearchHit:
    id: str
    score: float
    metadata: dict


@dataclass(frozen=True)
class SearchResponse:
    hits: list[SearchHit]
    strategy: str
    selectivity: float


class Collection:
    def __init__(self, files: Files, folder: str, manifest: dict, durability: DurabilityConfig, filter_config: FilterConfig, is_durable: bool = True):
        self.files, self.folder, self.manifest, self.is_durable = files, folder, manifest, is_durable
        self.spark: SparkSession = files.spark
        self.durability, self.filter_config = durability, filter_config
        self.config = CollectionConfig.from_dict(manifest["config"])
        self.manifests = Manifests(files, folder)
        self._writer = threading.RLock()

    # -- what there is

    @property
    def name(self) -> str:
        return self.config.name

    @property
    def last_lsn(self) -> int:
        return self.manifest["last_lsn"]

    @staticmethod
    def new_manifest(config: CollectionConfig) -> dict:
        return {"version": 0, "config": config.to_dict(), "next_ord": 0, "last_lsn": 1, "segments": [], "snapshot": None, "indexes": [], "remap": None, "stored": 0, "live": 0, "compactions": 0}

    def _at(self, name: str) -> str:
        return self.files.path(f"{self.folder}/{name}")

    @staticmethod
    def _fresh(kind: str) -> str:
        """A name that no other writer has: what loses the race for a version must not touch what won it."""
        return f"{kind}-{uuid.uuid4().hex}"

    def _read(self, schema: str, *entries: dict) -> DataFrame:
        return self.spark.read.options(**CHECKED).schema(schema).parquet(*[self._at(e["path"]) for e in entries])

    def _write(self, rows: DataFrame, kind: str) -> dict:
        """Writes rows to a new folder; returns its manifest entry."""
        path = self._fresh(kind)
        rows.write.parquet(self._at(path))
        return {"path": path, "bytes": self.files.size(f"{self.folder}/{path}")}

    def log(self, after: int = 0, manifest: dict | None = None) -> DataFrame:
        """The change log of the version beyond an lsn."""
        segments = [s for s in (manifest or self.manifest)["segments"] if s["to"] > after]
        rows = self._read(LOG, *segments) if segments else self.spark.createDataFrame([], LOG)
        return rows.where(F.col("lsn") > after)

    def points(self, manifest: dict | None = None) -> DataFrame:
        """Live points (id, ord, prepared vector, metadata maps) of a version: those of the snapshot whose ids the log doesn't
        name, and of the log the last upserts. Only ids and numbers decide; a snapshot's vectors stay where they are, and the
        log's are fetched for live points alone."""
        manifest = manifest or self.manifest
        snapshot = manifest["snapshot"]
        base = self._read(POINTS, snapshot) if snapshot else None
        if not manifest["segments"]:
            return base if base is not None else self.spark.createDataFrame([], POINTS)
        log = self.log(snapshot["lsn"] if snapshot else 0, manifest)
        fresh = changes.latest(log, "ord", "vector", *MAPS).select("id", "ord", "vector", *MAPS)
        if base is None:
            return fresh
        return base.join(log.select("id").distinct(), "id", "left_anti").unionByName(fresh)

    def _known(self, ids: DataFrame) -> DataFrame:
        """(id) of the live points among ``ids`` (id). Few ids become a filter that skips most of a sorted snapshot."""
        few = [r.id for r in ids.select("id").distinct().limit(FEW_IDS + 1).collect()]
        live = self.points().select("id")
        return live.where(F.col("id").isin(few)) if len(few) <= FEW_IDS else live.join(ids.select("id").distinct(), "id", "left_semi")

    def stats(self) -> dict:
        m = self.manifest
        return {"name": self.name, "config": self.config, "live": m["live"], "tombstones": m["stored"] - m["live"], "memory_bytes": m["stored"] * self.config.dim * 4, "compactions": m["compactions"], "last_lsn": m["last_lsn"]}

    def get(self, point_id: str) -> Row | None:
        rows = self.points().where(F.col("id") == point_id).collect()
        return rows[0] if rows else None

    # -- changes

    def frame(self, batch: list[tuple[str, list[float], dict | None]]) -> DataFrame:
        return self.spark.createDataFrame([(i, point_id, [float(x) for x in vector], *M.split(meta)) for i, (point_id, vector, meta) in enumerate(batch)], BATCH)

    def _checked(self, rows: DataFrame) -> None:
        """Raises what is wrong with the first point that isn't accepted."""
        why = rows.withColumn("why", V.invalid(self.config.metric, self.config.dim, F.col("id"), F.col("vector"))).where("why is not null")
        if bad := why.groupBy().agg(F.min_by("why", "pos").alias("why")).first().why:
            raise ValueError(bad)

    def upsert(self, batch: DataFrame | list) -> int:
        """Adds or replaces points, all or none; of equal ids the last by ``pos`` stays. ``batch`` is a list of (id, vector,
        metadata) or a DataFrame (pos, id, vector, meta_str, meta_num, meta_bool) whose pos differ. Returns the last lsn."""
        rows = self.frame(batch) if isinstance(batch, list) else batch.select(*[c.split()[0] for c in BATCH.split(", ")])
        self._checked(rows)
        with self._writer:
            m = self.manifest
            prepared = rows.withColumn("vector", V.prepare(self.config.metric, F.col("vector")))
            numbered = changes.dense_order(prepared, "pos", "at")
            columns = [(F.lit(m["last_lsn"] + 1) + F.col("at")).alias("lsn"), F.lit(changes.UPSERT).cast("tinyint").alias("op"), "id", (F.lit(m["next_ord"]) + F.col("at")).alias("ord"), "vector", *MAPS]
            return self._append(numbered.select(*columns))

    def delete(self, *ids: str) -> list[bool]:
        """Whether each id was there; those that were are gone."""
        with self._writer:
            wanted = list(dict.fromkeys(ids))
            there = {r.id for r in self._known(self.spark.createDataFrame([(x,) for x in wanted], "id string")).collect()}
            gone = [x for x in wanted if x in there]
            if gone:
                rows = [(self.last_lsn + 1 + i, changes.DELETE, x) for i, x in enumerate(gone)]
                self._append(self._deletes(self.spark.createDataFrame(rows, "lsn long, op tinyint, id string")))
            seen: set[str] = set()
            return [x in there and not (x in seen or seen.add(x)) for x in ids]

    def delete_frame(self, ids: DataFrame) -> int:
        """Deletes all of ``ids`` (id) that are there, however many; returns how many were."""
        with self._writer:
            gone = self._known(ids).persist()
            try:
                n = gone.count()
                if n:
                    numbered = changes.dense_order(gone, "id", "at", total=n)
                    self._append(self._deletes(numbered.select((F.lit(self.last_lsn + 1) + F.col("at")).alias("lsn"), F.lit(changes.DELETE).cast("tinyint").alias("op"), "id")))
                return n
            finally:
                gone.unpersist()

    def apply(self, batch: DataFrame) -> int:
        """Applies changes (pos, op, id, vector, maps), whose pos differ, in one commit: the last change of each id counts, and
        a delete of what isn't there does nothing. Returns the last lsn."""
        rows = changes.last_of_batch(batch.select("op", *[c.split()[0] for c in BATCH.split(", ")])).persist()
        try:
            upserts = rows.where(F.col("op") == changes.UPSERT)
            self._checked(upserts)
            with self._writer:
                m = self.manifest
                gone = rows.where(F.col("op") == changes.DELETE)
                gone = gone.join(self._known(gone), "id", "left_semi")
                prepared = upserts.withColumn("vector", V.prepare(self.config.metric, F.col("vector")))
                numbered = changes.dense_order(prepared.select("pos", "op", "id", "vector", *MAPS).union(gone.select("pos", "op", "id", F.lit(None).cast("array<float>"), *[F.lit(None).cast(t) for t in M.TYPES.values()])), "pos", "at")
                order = F.when(F.col("op") == changes.UPSERT, F.lit(m["next_ord"]) + F.col("at"))
                return self._append(numbered.select((F.lit(m["last_lsn"] + 1) + F.col("at")).alias("lsn"), F.col("op").cast("tinyint").alias("op"), "id", order.alias("ord"), "vector", *MAPS))
        finally:
            rows.unpersist()

    @staticmethod
    def _deletes(rows: DataFrame) -> DataFrame:
        kinds = dict(x.split(maxsplit=1) for x in ("vector array<float>", "meta_str map<string,string>", "meta_num map<string,double>", "meta_bool map<string,boolean>"))
        return rows.select("lsn", "op", "id", F.lit(None).cast("long").alias("ord"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    def _append(self, rows: DataFrame) -> int:
        m = self.manifest
        entry = self._write(rows, f"log-{m['last_lsn'] + 1:020d}")
        written = self._read(LOG, entry)
        total = written.agg(F.count("*").alias("n"), F.max("lsn").alias("last"), F.coalesce(F.max("ord") + 1, F.lit(m["next_ord"])).alias("next_ord"), F.count_if(F.col("op") == changes.UPSERT).alias("upserts")).first()
        if not total.n:
            return m["last_lsn"]
        # Only ids are read of what is there, and only those of the batch count.
        before = self._known(written).withColumn("known", F.lit(True))
        sums = changes.last_changes(written).join(before, "id", "left").agg(
            F.count_if((F.col("op") == changes.UPSERT) & F.col("known").isNull()).alias("new"), F.count_if((F.col("op") == changes.DELETE) & F.col("known").isNotNull()).alias("gone")).first()
        segments = self._merged([*m["segments"], {**entry, "from": m["last_lsn"] + 1, "to": total.last, "rows": total.n}])
        self._publish({**m, "segments": segments, "last_lsn": total.last, "next_ord": total.next_ord, "stored": m["stored"] + total.upserts, "live": m["live"] + sums.new - sums.gone})
        m = self.manifest
        if changes.needs_compaction(m["stored"] - m["live"], m["stored"], self.durability.compact_above):
            self.compact()
        elif self.durability.snapshot_every and total.last - (m["snapshot"] or {"lsn": 0})["lsn"] >= self.durability.snapshot_every:
            self.snapshot()
        every = self.durability.index_every
        if every and self.config.index != "FLAT" and self.manifest["next_ord"] - self._indexed() >= every:
            self._extend_index()
        return total.last

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The segments, with the newest ones of about one size written as one when there are ``merge_segments`` of them, so
        that many small commits leave few segments, and a row is written again only as often as its segment's size grows."""
        many = self.durability.merge_segments
        size = lambda s: int(math.log(s["rows"], many))
        for most in sorted({size(s) for s in segments}):
            tail = 0
            while tail < len(segments) and size(segments[-1 - tail]) <= most:
                tail += 1
            if tail >= many:
                old = segments[-tail:]
                entry = self._write(self._read(LOG, *old).repartitionByRange("lsn").sortWithinPartitions("lsn"), f"log-{old[0]['from']:020d}")
                return [*segments[:-tail], {**entry, "from": old[0]["from"], "to": old[-1]["to"], "rows": sum(s["rows"] for s in old)}]
        return segments

    def _publish(self, manifest: dict) -> None:
        manifest = {**manifest, "version": self.manifest["version"] + 1}
        self.manifests.commit(manifest)
        self.manifest = manifest

    def verify(self) -> None:
        """Reads every listed file, which compares its pages with their checksums, and compares its size and rows with what the
        manifest says. Sizes alone are compared whenever a collection is opened."""
        for s in self.manifest["segments"]:
            try:
                row = self._read(LOG, s).agg(F.count("*").alias("n"), F.min("lsn").alias("a"), F.max("lsn").alias("b"), F.bit_xor(F.xxhash64("id", "ord", "vector")).alias("all")).first()
            except Exception as e:
                raise LogCorruptedError(s["path"]) from e
            if (row.n, row.a, row.b) != (s["rows"], s["from"], s["to"]):
                raise LogCorruptedError(s["path"])
        for e in self.manifests.entries(self.manifest):
            if self.files.size(f"{self.folder}/{e['path']}") != e["bytes"]:
                raise SnapshotCorruptedError(e["path"])
        if snapshot := self.manifest["snapshot"]:
            try:
                self._read(POINTS, snapshot).agg(F.bit_xor(F.xxhash64("id", "ord", "vector"))).first()
            except Exception as e:
                raise SnapshotCorruptedError(snapshot["path"]) from e

    # -- maintenance

    def snapshot(self) -> int:
        """Writes the live points as a snapshot, drops the log it covers, keeps the newest snapshots. Returns its lsn."""
        with self._writer:
            self._rewrite(self.points(), {})
            return self.last_lsn

    def compact(self) -> DataFrame:
        """Drops dead versions, numbers the live ones anew, in order, and builds the graphs anew if there are any, all in one
        commit; returns (ord, new_ord) of the live ones."""
        with self._writer:
            m = self.manifest
            remap = self._write(changes.dense_order(self.points().select(F.col("ord").alias("old_ord")), "old_ord", "ord").select(F.col("old_ord").alias("ord"), F.col("ord").alias("new_ord")), "remap")
            moves = self._read("ord long, new_ord long", remap)
            moved = self.points().join(moves, "ord").drop("ord").withColumnRenamed("new_ord", "ord")
            self._rewrite(moved, {"stored": m["live"], "next_ord": m["live"], "compactions": m["compactions"] + 1, "remap": remap}, again=True)
            return moves

    def _rewrite(self, points: DataFrame, changed: dict, again: bool = False) -> None:
        m = self.manifest
        entry = self._write(points.select("id", "ord", "vector", *MAPS).repartitionByRange("id").sortWithinPartitions("id"), f"snapshot-{m['last_lsn']:020d}")
        after = {**m, "snapshot": {**entry, "lsn": m["last_lsn"]}, "segments": [], **changed}
        if again and m["indexes"]:
            after["indexes"] = [self._graphs(after, 0, m["indexes"][0]["shard_rows"])] if after["live"] else []
        self._publish(after)
        self.manifests.prune(self.durability.keep_snapshots)

    def _graphs(self, manifest: dict, above: int, shard_rows: int) -> dict:
        """Builds graphs over the version's points from ordinal ``above`` on; returns their manifest entry."""
        points = self.points(manifest).where(F.col("ord") >= above).select("ord", "vector")
        entry = self._write(ann.build_index(points, self.config.metric, self.config.hnsw, shard_rows, self.config.index), "index")
        held = self._read(ann.INDEX, entry).agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        return {**entry, "from": above, "below": manifest["next_ord"], "shards": held.shards, "rows": held.rows, "shard_rows": shard_rows}

    def _indexed(self) -> int:
        """The ordinal below which points are in graphs."""
        return max((x["below"] for x in self.manifest["indexes"]), default=0)

    def build_index(self, shard_rows: int = ann.SHARD_ROWS) -> None:
        """Builds graphs over all live points. Later points are scanned until ``index_every`` of them have come, which then get
        graphs of their own."""
        with self._writer:
            self._publish({**self.manifest, "indexes": [self._graphs(self.manifest, 0, shard_rows)]})

    def _extend_index(self) -> None:
        """Adds graphs over the points that came since the last ones; when there are many, builds one set over all."""
        m = self.manifest
        if not m["live"]:
            return
        rows = m["indexes"][0]["shard_rows"] if m["indexes"] else ann.SHARD_ROWS
        more = [*m["indexes"], self._graphs(m, self._indexed(), rows)] if len(m["indexes"]) < MOST_INDEXES else [self._graphs(m, 0, rows)]
        self._publish({**m, "indexes": more})

    # -- search

    def plan(self, k: int, params: SearchParams = SearchParams(), where: filters.Filter | dict | None = None, also: Column | None = None, manifest: dict | None = None) -> tuple[Plan, DataFrame]:
        """The strategy for a search and the points that it may return. ``also`` is any further predicate on the points'
        columns, such as one on ``ord`` or ``id``."""
        for name, value, least, most in (("k", k, 1, MAX_K), ("ef", params.ef, 0, MAX_EF)):
            if not least <= value <= most:
                raise ValueError(f"{name} is {value}, but a number from {least} to {most} is needed")
        where = filters.parse(where) if isinstance(where, dict) else where
        points = self.points(manifest)
        tests = [x for x in (where.column() if where else None, also) if x is not None]
        predicate = reduce(Column.__and__, tests) if tests else None
        chosen = plan(points, predicate, k, params.ef, self.config.default_ef, self.filter_config)
        if chosen.strategy == "FILTERED_INDEX" and self.config.index != "FLAT" and not (manifest or self.manifest)["indexes"]:
            chosen = replace(chosen, strategy="EXACT_SCAN", ef=0)  # there are no graphs yet
        return chosen, points if predicate is None else points.where(predicate)

    def _scans(self, chosen: Plan, manifest: dict) -> bool:
        return chosen.strategy == "EXACT_SCAN" or self.config.index == "FLAT" or not manifest["indexes"]

    def _graph_hits(self, queries: DataFrame, k: int, chosen: Plan, eligible: DataFrame, manifest: dict) -> DataFrame:
        """(qid, rank, ord, score) from all graphs, and exactly from the points that have none yet."""
        # With no filter and nothing replaced since the graphs were built, every node is eligible.
        whole = chosen.strategy == "UNFILTERED" and manifest["stored"] == manifest["live"] == sum(x["rows"] for x in manifest["indexes"])
        fresh = eligible.where(F.col("ord") >= max(x["below"] for x in manifest["indexes"]))
        found = batch_topk(fresh, queries, k, self.config.metric).select("qid", "ord", "score")
        for x in manifest["indexes"]:
            within = None if whole else eligible.select("ord").where((F.col("ord") >= x["from"]) & (F.col("ord") < x["below"]))
            near = ann.search_index(self._read(ann.INDEX, x), queries, k, chosen.ef, within, x["shards"], self.config.metric, self.config.hnsw, self.config.index)
            found = found.union(near.select("qid", "ord", "score"))
        return merge_topk(found, k)

    def search_frame(self, query, k: int, params: SearchParams = SearchParams(), where: filters.Filter | dict | None = None, also: Column | None = None) -> tuple[DataFrame, Plan]:
        """(rank, id, score, ord, metadata maps) of the closest points that match, closest first, and the plan."""
        manifest = self.manifest
        q = V.check_query(self.config.metric, self.config.dim, query)
        chosen, eligible = self.plan(k, params, where, also, manifest)
        if chosen.strategy == "NO_MATCH":
            hits = self.spark.createDataFrame([], "ord long, score float")
        elif self._scans(chosen, manifest):
            hits = exact_topk(eligible, q, k, self.config.metric)
        else:
            queries = self.spark.createDataFrame([(0, [float(x) for x in q])], "qid long, vector array<float>")
            hits = self._graph_hits(queries, k, chosen, eligible, manifest).select("ord", "score")
        rank = F.row_number().over(Window.orderBy("score", "ord"))
        best = hits.withColumn("rank", rank)  # k rows at most
        return best.join(self.points(manifest).select("ord", "id", *MAPS), "ord").select("rank", "id", "score", "ord", *MAPS).orderBy("rank"), chosen

    def search_many(self, queries: DataFrame, k: int, params: SearchParams = SearchParams(), where: filters.Filter | dict | None = None, also: Column | None = None) -> tuple[DataFrame, Plan]:
        """(qid, rank, id, score, ord) for each of the queries (qid, vector), which are validated like points, and the plan."""
        manifest, metric = self.manifest, self.config.metric
        self._checked(queries.select(F.lit("query").alias("id"), "vector", F.col("qid").alias("pos")))
        chosen, eligible = self.plan(k, params, where, also, manifest)
        prepared = queries.select("qid", V.prepare(metric, F.col("vector")).alias("vector"))
        if chosen.strategy == "NO_MATCH":
            hits = self.spark.createDataFrame([], "qid long, rank int, ord long, score float")
        elif self._scans(chosen, manifest):
            hits = batch_topk(eligible, prepared, k, metric)
        else:
            hits = self._graph_hits(prepared, k, chosen, eligible, manifest)
        return hits.join(self.points(manifest).select("ord", "id"), "ord").select("qid", "rank", "id", "score", "ord"), chosen

    def search(self, query, k: int, params: SearchParams = SearchParams(), where: filters.Filter | dict | None = None, also: Column | None = None) -> SearchResponse:
        rows, chosen = self.search_frame(query, k, params, where, also)
        return SearchResponse([SearchHit(r.id, r.score, M.joined(r.meta_str, r.meta_num, r.meta_bool)) for r in rows.collect()], chosen.strategy, chosen.selectivity)
