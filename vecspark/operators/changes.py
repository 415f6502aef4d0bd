"""The state that a change log leaves behind: rows (lsn, op, id, ...) with op 1 for upserts and 2 for deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPSERT, DELETE, CREATE, DROP = 1, 2, 3, 4
RANGE_ROWS = 1_000_000


def last_changes(log: DataFrame) -> DataFrame:
    """(id, lsn, op) of the last upsert or delete of each id. One number a change says both, so changes are combined before
    the shuffle in whole-stage code, and an id with very many of them costs one row a task."""
    last = log.where(F.col("op").isin(UPSERT, DELETE)).groupBy("id").agg(F.max(F.col("lsn") * 4 + F.col("op")).alias("last"))
    return last.select("id", F.expr("last div 4").alias("lsn"), F.pmod("last", F.lit(4)).alias("op"))


def latest(log: DataFrame, *columns: str) -> DataFrame:
    """(id, lsn, ...) of the points that are live: the last change of each id, unless it is a delete. Other columns, such as
    vectors, are fetched for these changes only, by lsn, which differs between changes."""
    live = last_changes(log).where(F.col("op") == UPSERT).select("id", "lsn")
    return live.join(log.select("lsn", *columns), "lsn").select("id", "lsn", *columns) if columns else live


def with_ordinals(log: DataFrame, first: int = 0) -> DataFrame:
    """The log with ``ord``: upserts are numbered in order of their lsn. Rows are ranged by lsn and numbered within their
    part, plus what the parts before hold; no task sees more than its part."""
    upserts = log.where(F.col("op") == UPSERT)
    return dense_order(upserts, "lsn", "ord", first)


def dense_order(rows: DataFrame, by: str, name: str, first: int = 0, total: int | None = None) -> DataFrame:
    """``rows`` with a column ``name``: their numbers in order of ``by``, whose values differ, from ``first``."""
    spark = rows.sparkSession
    n = rows.count() if total is None else total
    parts = max(1, -(-n // RANGE_ROWS))
    if parts == 1:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(by)) - 1 + first).cast("long"))
    cuts = rows.approxQuantile(by, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    part = F.aggregate(F.lit(cuts), F.lit(0), lambda s, c: s + (F.col(by) > c).cast("int"))
    rows = rows.withColumn("order_part", part)
    counts = {r["order_part"]: r["count"] for r in rows.groupBy("order_part").count().collect()}
    starts, at = [], first
    for i in range(parts):
        starts.append((i, at))
        at += counts.get(i, 0)
    offsets = spark.createDataFrame(starts, "order_part int, order_start long")
    numbered = rows.withColumn("order_at", F.row_number().over(Window.partitionBy("order_part").orderBy(by)))
    return numbered.join(F.broadcast(offsets), "order_part").withColumn(name, F.col("order_start") + F.col("order_at") - 1).drop("order_part", "order_start", "order_at")


def counters(log: DataFrame) -> DataFrame:
    """One row: stored versions, live points, tombstones, and their ratio (0 when nothing is stored), without compaction."""
    by_id = log.where(F.col("op").isin(UPSERT, DELETE)).groupBy("id").agg(F.count_if(F.col("op") == UPSERT).alias("n"), F.max(F.col("lsn") * 4 + F.col("op")).alias("last"))
    sums = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stored"), F.count_if(F.pmod("last", F.lit(4)) == UPSERT).alias("live"))
    return sums.select("stored", "live", (F.col("stored") - F.col("live")).alias("tombstones"), ratio(F.col("stored") - F.col("live"), F.col("stored")).alias("tombstone_ratio"))


def ratio(tombstones: Column, stored: Column) -> Column:
    return F.when(stored > 0, tombstones / stored).otherwise(0.0)


def needs_compaction(tombstones: int | Column, stored: int | Column, above: float = 0.20) -> bool | Column:
    """Strictly more than the share; of numbers, or of columns."""
    if isinstance(stored, Column):
        return ratio(tombstones, stored) > above
    return stored > 0 and tombstones / stored > above


def remap(versions: DataFrame) -> DataFrame:
    """(ord, new_ord) of stored versions (ord, live): live ones are numbered anew in their order, the others have -1."""
    live = dense_order(versions.where("live").select("ord"), "ord", "new_ord")
    return live.union(versions.where("not live").select("ord", F.lit(-1).cast("long")))


def last_of_batch(batch: DataFrame) -> DataFrame:
    """Of a batch (pos, id, ...), whose pos differ, the last row of each id; equal ids keep the highest pos."""
    others = [c for c in batch.columns if c not in ("id", "pos")]
    last = batch.groupBy("id").agg(F.max("pos").alias("pos"))
    return last.join(batch.select("pos", *others), "pos").select("id", "pos", *others)
