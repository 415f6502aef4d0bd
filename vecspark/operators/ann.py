"""Approximate search: a graph for each shard of points, built once, and a fan-out over shards with exact scores.

Shards hold at most about SHARD_ROWS points, dealt by a hash of the ordinal, so building and searching are spread evenly
and a task's memory is bounded. A shard is one row with its vectors and links as plain arrays in binary form. Searching asks
every shard for its k best and merges k rows a query and shard; points don't move. Which ordinals are eligible (live, matching
a filter) is joined to shards as one array each."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark import config
from vecspark.config import HnswParams
from vecspark.operators.hnsw import HnswGraph
from vecspark.operators.topk import merge_topk, query_blocks

SHARD_ROWS = 20_000
INDEX = "shard int, n long, graph binary"


class ShardIndex(Protocol):
    """What a kind of index builds for one shard of points, stores as bytes, and searches."""

    ords: np.ndarray

    @classmethod
    def build(cls, metric: str, params: HnswParams, ords: np.ndarray, vectors: np.ndarray) -> ShardIndex: ...

    def to_bytes(self) -> bytes: ...

    @classmethod
    def from_bytes(cls, metric: str, params: HnswParams, data: bytes) -> ShardIndex: ...

    def search(self, q: np.ndarray, k: int, ef: int, eligible: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]: ...


def _found(graph: ShardIndex, queries: np.ndarray, k: int, ef: int, eligible: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ordinals and scores of a shard's hits; one query after the other where a kind has no ``search_many``."""
    if hasattr(graph, "search_many"):
        return graph.search_many(queries, k, ef, eligible)
    hits = [graph.search(q, k, ef, eligible) for q in queries]
    return np.repeat(np.arange(len(hits)), [len(o) for o, _ in hits]), np.concatenate([o for o, _ in hits]), np.concatenate([s for _, s in hits])


KINDS: dict[str, type[ShardIndex]] = {"HNSW": HnswGraph}


def register(name: str, kind: type[ShardIndex]) -> None:
    """Makes a kind of index known under a name that a collection's config may then have."""
    KINDS[name] = kind
    config.INDEXES.add(name)


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("ord"), F.lit(n_shards)).cast("int")


def build_index(points: DataFrame, metric: str, params: HnswParams = HnswParams(), shard_rows: int = SHARD_ROWS, kind: str = "HNSW") -> DataFrame:
    """One row for each shard of points (ord, prepared vector)."""
    shards, made = max(1, -(-points.count() // shard_rows)), KINDS[kind]

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        graph = made.build(metric, params, rows["ord"].to_numpy(), np.stack(rows["vector"].to_numpy()))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n": [len(rows)], "graph": [graph.to_bytes()]})

    # About one task for each shard: by their bytes alone, small tables would be built by a task or two.
    dealt = points.select("ord", "vector", shard_of(shards).alias("shard")).repartition(shards, "shard")
    return dealt.groupBy("shard").applyInPandas(built, INDEX)


def graph_rows(index: DataFrame, metric: str = "L2", params: HnswParams = HnswParams()) -> DataFrame:
    """The links as a table: (shard, node, level, layer, neighbours), all by ordinals."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in zip(batch["shard"], batch["graph"], strict=True):
                rows = HnswGraph.from_bytes(metric, params, data).rows()
                yield pd.DataFrame({"shard": shard, "node": [r[0] for r in rows], "level": [r[1] for r in rows], "layer": [r[2] for r in rows], "neighbours": [r[3] for r in rows]})

    return index.mapInPandas(listed, "shard int, node long, level int, layer int, neighbours array<long>")


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = 0, eligible: DataFrame | None = None, n_shards: int | None = None,
                 metric: str = "L2", params: HnswParams = HnswParams(), kind: str = "HNSW") -> DataFrame:
    """(qid, rank, ord, score) of about the k closest points to each of the queries (qid, prepared vector); with ``eligible``
    (ord) only of those."""
    if eligible is not None:
        shards = n_shards or index.count()
        allowed = eligible.select("ord", shard_of(shards).alias("shard")).groupBy("shard").agg(F.collect_list("ord").alias("allowed"))
        index = index.join(allowed, "shard")
    else:
        index = index.withColumn("allowed", F.lit(None).cast("array<bigint>"))
    out, made = None, KINDS[kind]
    for qids, many in query_blocks(queries):
        shared = index.sparkSession.sparkContext.broadcast((qids, many))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, queries = shared.value
            for batch in batches:
                for data, allowed in zip(batch.column("graph"), batch.column("allowed"), strict=True):
                    graph = made.from_bytes(metric, params, data.as_py())
                    flags = np.isin(graph.ords, allowed.values.to_numpy()) if allowed.is_valid else None
                    places, ords, scores = _found(graph, queries, k, ef, flags)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[places]), pa.array(ords), pa.array(scores)], names=["qid", "ord", "score"])

        part = merge_topk(index.select("graph", "allowed").mapInArrow(found, "qid long, ord long, score float"), k)
        out = part if out is None else out.union(part)
    return out if out is not None else index.sparkSession.createDataFrame([], "qid long, rank int, ord long, score float")
