"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Sources are the partitions in which the table is read. How many rows each source sends to each shard is drawn first, exactly
as a uniform permutation of all rows would have it: source after source draws from what room the shards have left (a
multivariate hypergeometric law with fixed row and column sums). Each source permutes its rows where they are and cuts them
at the drawn counts, the rows go to their shards in the one exchange, and each shard permutes what it got. The result is a
uniform shuffle, and shard sizes differ by one at most.

Everything random is a hash of a seed and of a row number that is written once, with the row's place in its source's
permutation, before the draw, so a task that is run again after a lost executor makes the same choice. The matrix has a row
for each source, is drawn on the driver CHUNK sources at a time, written as a table, and broadcast only if it has few rows. No
text is shuffled, and no key decides where a row goes, so hot sources or groups of copies don't matter.

Nulls: a null text has no bytes, crc32 of nothing is 0; a null doc_id is a row like any other. Repeated rows are dealt
one by one. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from itertools import accumulate
from math import e, exp, floor, lgamma, log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import shared_dir, stored, text_of

#: Rows that one task orders within a shard, on average.
BUCKET_ROWS = 200_000
#: Sources whose counts are drawn and written together, and rows of the matrix that are broadcast at most: 20 MB for 24 shards.
CHUNK, BROADCAST_SOURCES = 2_000, 100_000
#: A row's number has its source above these bits, and its place in the source below.
SOURCE_BITS = 33
#: Standard deviation from which a draw is made by rejection.
WIDE = 30.0


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls out of good + bad are good, exactly.

    A narrow law is inverted outward from its mode, where neighbours' probabilities are in rational ratios; a wide one is
    drawn by ratio of uniforms, whose hat covers any law with one mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    weight = lambda k: -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(draws - k + 1) + lgamma(bad - draws + k + 1))
    deviation = sqrt(draws / total * good * (bad / total) * (total - draws) / (total - 1))
    if deviation > WIDE:
        top, middle, width = weight(mode), draws * good / total + 0.5, 2 * sqrt(2 / e) * sqrt(deviation**2 + 0.5) + 3 - 2 * sqrt(3 / e)
        while True:
            u = 1.0 - rng.random()
            k = floor(middle + width * (rng.random() - 0.5) / u)
            if low <= k <= high and 2 * log(u) <= weight(k) - top:
                return k
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    at = exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random()
    down = up = mode
    p_down = p_up = at
    if u < at:
        return mode
    u -= at
    while down > low or up < high:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if u < p_up:
                return up
            u -= p_up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if u < p_down:
                return down
            u -= p_down
    return mode


def communication_matrix(rows: list[int], room: list[int], seed: int) -> Iterator[list[int]]:
    """Counts of each source by shard with the given row and column sums, as a uniform permutation has them."""
    rng, room, total = random.Random(seed), list(room), sum(room)
    for n in rows:
        counts, left, need = [], total, n
        for s, r in enumerate(room):
            left -= r
            take = hypergeometric(rng, r, left, need)
            counts.append(take)
            room[s] -= take
            need -= take
        total -= n
        yield counts


def written_matrix(rows: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int, int]:
    """(source, bounds) as a table, the number of sources and that of all rows: row number ``at`` of a source goes to the shard
    that as many of its bounds as are at most ``at`` name. What reaches the driver is one count for each source."""
    spark = rows.sparkSession
    counted = sorted((r.source, r.n) for r in rows.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator())
    total = sum(n for _, n in counted)
    matrix = communication_matrix([n for _, n in counted], [total // shards + (s < total % shards) for s in range(shards)], seed)
    path = shared_dir(spark, "shard-matrix")
    for first in range(0, max(1, len(counted)), CHUNK):
        lines = [{"source": source, "bounds": list(accumulate(counts))} for (source, _), counts in zip(counted[first : first + CHUNK], matrix, strict=False)]
        parsed = F.from_json(F.lit(json.dumps(lines)), "array<struct<source: bigint, bounds: array<bigint>>>")
        spark.range(1).select(F.inline(parsed)).write.mode("append").parquet(path)
    return spark.read.schema("source long, bounds array<long>").parquet(path), len(counted), total


def hypergeometric_shards(docs: DataFrame, shards: int = 24, seed: int = 20_240_229, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    text = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    # Each source permutes its rows in place; the number that a row then gets has its source and its place there.
    permuted = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "row"), "row").withColumn("placed", F.monotonically_increasing_id())
    rows = stored(permuted, "shard-rows").withColumns({"source": F.shiftright("placed", SOURCE_BITS), "at": F.col("placed").bitwiseAND(F.lit((1 << SOURCE_BITS) - 1))})
    matrix, sources, total = written_matrix(rows, shards, seed)
    # Permute within the shard: by a hash whose leading part deals the shard's rows over buckets, sorted one by one.
    buckets = max(8, -(-total // (shards * bucket_rows)))
    key = F.xxhash64(F.lit(seed + 2), "row")
    dealt = rows.join(F.broadcast(matrix) if sources <= BROADCAST_SOURCES else matrix, "source").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("at")))).drop("bounds", "source", "at", "placed")
    dealt = stored(dealt.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "bucket").orderBy("key", "row")
    return (dealt.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(starts) if shards * buckets <= BROADCAST_SOURCES else starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
