"""Exact top-k by distance, then ordinal: for one query, and for a batch of queries against all points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import vector as V

#: Bytes of the queries that are broadcast together: 1,024 at dim 4096, 65,536 at dim 64.
QUERY_BYTES = 16 << 20


def exact_topk(points: DataFrame, query, k: int, metric: str = "L2") -> DataFrame:
    """(ord, score) of the k points (ord, vector) closest to a prepared query. Only these two columns are read, each task
    keeps k rows, and one task merges them."""
    return points.select("ord", V.distance(metric, F.col("vector"), V.literal(query)).alias("score")).orderBy("score", "ord").limit(k)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows, without a copy where Arrow allows it."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _closest(metric: str, queries: np.ndarray, ords: np.ndarray, many: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, q in enumerate(queries):
        score = V.distances(metric, many, q)
        if len(score) > k:
            edge = np.partition(score, k - 1)[k - 1]
            inside = np.flatnonzero(score <= edge)
        else:
            inside = np.arange(len(score))
        order = inside[np.lexsort((ords[inside], score[inside]))][:k]
        yield i, ords[order], score[order]


def merge_topk(rows: DataFrame, k: int) -> DataFrame:
    """(qid, rank, ord, score): the k best of each query among (qid, ord, score)."""
    best = Window.partitionBy("qid").orderBy("score", "ord")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "ord", "score")


def batch_topk(points: DataFrame, queries: DataFrame, k: int, metric: str = "L2") -> DataFrame:
    """(qid, rank, ord, score) of the k points (ord, vector) closest to each of the queries (qid, vector), all prepared.

    Queries go out in blocks of QUERY_BYTES, so what is broadcast is bounded. Each batch of points is scored in numpy and
    trimmed to k a query before anything is shuffled; points themselves never are."""
    out = None
    for qids, many in query_blocks(queries):
        shared = points.sparkSession.sparkContext.broadcast((qids, many))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, queries = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ords, many = batch.column("ord").to_numpy(), matrix(batch.column("vector"), queries.shape[1])
                found = list(_closest(metric, queries, ords, many, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(o), qids[i]) for i, o, _ in found])), pa.array(np.concatenate([o for _, o, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                    names=["qid", "ord", "score"])

        part = merge_topk(points.select("ord", "vector").mapInArrow(scored, "qid long, ord long, score float"), k)
        out = part if out is None else out.union(part)
    if out is None:
        out = points.sparkSession.createDataFrame([], "qid long, rank int, ord long, score float")
    return out


def pairwise(points: DataFrame, queries: DataFrame, metrics: tuple[str, ...] = ("L2", "DOT")) -> DataFrame:
    """(qid, ord, a distance for each metric) between every query (qid, vector) and every point (ord, vector), all prepared.
    Points are scanned once for each block of queries and never shuffled."""
    names = [m.lower() for m in metrics]
    schema, out = ", ".join(["qid long, ord long", *[f"{n} float" for n in names]]), None
    for qids, many in query_blocks(queries):
        shared = points.sparkSession.sparkContext.broadcast((qids, many))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, queries = shared.value
            for batch in batches:
                if batch.num_rows:
                    ords, many = batch.column("ord"), matrix(batch.column("vector"), queries.shape[1])
                    for qid, q in zip(qids.tolist(), queries, strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ords), qid)), ords, *[pa.array(V.distances(m, many, q)) for m in metrics]], names=["qid", "ord", *names])

        part = points.select("ord", "vector").mapInArrow(scored, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else points.sparkSession.createDataFrame([], schema)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors, about QUERY_BYTES of vectors at a time."""
    qids, many = [], []
    for row in queries.select("qid", "vector").toLocalIterator():
        qids.append(row.qid)
        many.append(row.vector)
        if 4 * len(qids) * len(row.vector) >= QUERY_BYTES:
            yield np.array(qids, np.int64), np.array(many, np.float32)
            qids, many = [], []
    if qids:
        yield np.array(qids, np.int64), np.array(many, np.float32)


def with_details(hits: DataFrame, points: DataFrame, *columns: str) -> DataFrame:
    """Hits joined back to other columns of their points: fetched for final hits only."""
    return hits.join(points.select("ord", *columns), "ord")


def recall(got: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the mean over queries of the share of true neighbours (qid, ord) that were found."""
    both = truth.groupBy("qid").agg(F.collect_set("ord").alias("want")).join(got.groupBy("qid").agg(F.collect_set("ord").alias("got")), "qid", "left")
    return both.agg(F.avg(F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>")))) / F.lit(k)).alias("recall"))
