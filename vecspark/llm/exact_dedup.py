"""Exact deduplication over a log-structured merge index of digests.

Rows are written once with a number and a digest each. They enter the index as memtables of MEMTABLE_ROWS successive rows of
a task, and each memtable is flushed as a run, sorted by digest. Compaction merges FANOUT runs into one of the next level,
level by level until one is left, with an entry for each digest: how many rows have it, and the row that stays. All groups
of a level are merged in one job, so the number of jobs grows with the logarithm of the number of runs.

The index carries a filter over the digests that several rows have. Rows look it up: one that doesn't pass is single, and
neither it nor its text is shuffled. Every hit, that is every row whose digest another row has too, is verified byte by byte
against the row that stays. Rows that fail (a collision of digests) are grouped anew by their whole text, so the result is
right for any digest function, even a poor one. Nothing is gathered by group: counts and minima are combined before the
shuffle, and a group of n hits is verified by n / HITS_PER_TASK salted joins.

Nulls: a null text is an empty one. A null doc_id sorts first, as Spark has it. Of rows that are equal in length and doc_id
too, the one that comes first in the table stays, and only it counts as kept. Empty tables give an empty result. Columns
other than doc_id and text are not looked at; ``drop_copies`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import BitFilter, keyed, stored, text_of, without, without_space

#: Hits of one group that are verified against one copy of the kept text.
HITS_PER_TASK = 2_000
#: Rows of a memtable, and runs that are merged into one of the next level.
MEMTABLE_ROWS, FANOUT = 4096, 128
#: A row's number has the task above these bits, and its place in the task's output below.
TASK_BITS = 33


def sha256(text: Column) -> Column:
    # A digest is never null, but Spark would test that it isn't, by computing it again in a filter below each join on it.
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each run and digest: the most code points stay, then the smallest identifier, then the first row."""
    best = F.min(F.struct((-F.col("points")).alias("less"), "keep_id", "keep_row"))
    return entries.groupBy("run", "digest").agg(F.sum("n").alias("n"), best.alias("best")).select("run", "digest", "n", (-F.col("best.less")).alias("points"), "best.keep_id", "best.keep_row")


class DigestIndex:
    """A log-structured merge index from digest to (n rows, points, keep_id and keep_row of the row that stays).

    ``runs`` has the number of runs of each level, from the memtables' level on; a level's runs are parts of one table, sorted by
    run and digest."""

    def __init__(self, rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        """Flushes rows (row, doc_id, points, digest) and compacts until one run is left."""
        task, at = F.shiftright("row", TASK_BITS), F.col("row").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
        most = rows.agg(F.max(task).alias("task"), F.max(at).alias("at")).first()
        per_task = (most.at or 0) // memtable_rows + 1
        run = task * per_task + F.floor(at / memtable_rows)
        entries = rows.select(run.alias("run"), "digest", F.lit(1).cast("long").alias("n"), "points", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
        self.entries = stored(entries.sortWithinPartitions("run", "digest"), "digest-runs")
        self.runs, last = [self.entries.select("run").distinct().count()], (most.task or 0) * per_task + per_task - 1
        while last:
            last //= fanout
            self.entries = stored(_merged(self.entries.withColumn("run", F.floor(F.col("run") / fanout))), "digest-level")
            self.runs.append(last + 1)
        if len(self.runs) == 1:
            self.entries = stored(_merged(self.entries), "digest-level")

    def hits(self) -> DataFrame:
        """The entries of digests that several rows have."""
        return stored(self.entries.where("n > 1").select("digest", "n", F.col("points").alias("keep_points"), "keep_id", "keep_row"), "hits")


def _verified(found: DataFrame) -> DataFrame:
    """The hits with ``same``: the text equals that of the row that stays.

    The text of a row that stays is copied once for every HITS_PER_TASK hits, and the hits are dealt over these copies."""
    salts = F.ceil(F.col("n") / HITS_PER_TASK).cast("int")
    kept = found.where("row = keep_row").select("digest", F.col("bytes").alias("keep_bytes"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    return dealt.join(kept, ["digest", "salt"]).select("digest", (F.col("bytes") == F.col("keep_bytes")).alias("same"))


def _decided(docs: DataFrame, digest: Callable[[Column], Column], memtable_rows: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The rows as written (row, whole, ...), and what is decided of each: row, doc_id, keep_id, keep_row, group_size, sha."""
    text = without_space(text_of())
    own = {} if digest is sha256 else {"digest": digest(text).cast("binary")}
    whole = keyed(docs, "digested", points=F.char_length(text_of()).cast("int"), sha=sha256(text), **own)
    rows = whole.select("row", "whole.doc_id", "points", "sha", F.col("sha" if digest is sha256 else "digest").alias("digest"))
    hits = DigestIndex(rows, memtable_rows, fanout).hits()
    shared = BitFilter(hits, "digest")
    looked = shared.marked(rows)
    passed = shared.passing(whole.select("row", "whole.doc_id", "points", "sha", F.col("sha" if digest is sha256 else "digest").alias("digest"), without_space(text_of("whole.text")).alias("bytes")))
    found = stored(passed.join(hits, "digest", "left").withColumn("bytes", F.expr("if(n is null, null, bytes)")), "found")
    hit = found.where("n is not null")
    collided = stored(_verified(hit).where("not same").select("digest").distinct(), "collided")
    alone = [F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), "sha"]
    out = looked.where("not in_filter").unionByName(found.where("n is null").select(*rows.columns), allowMissingColumns=True).select("row", "doc_id", *alone)
    collisions = not collided.isEmpty()
    clean = hit.join(collided, "digest", "left_anti") if collisions else hit
    out = out.unionByName(clean.select("row", "doc_id", "keep_id", "keep_row", F.col("n").alias("group_size"), "sha"))
    if collisions:
        # A digest with any row that differs from the kept one is a collision: its rows are grouped by their whole text.
        again = hit.select("row", "doc_id", "points", "bytes", "digest", "sha").join(collided, "digest", "left_semi")
        best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
        by_text = again.groupBy("bytes").agg(F.count("*").alias("group_size"), best.alias("best")).select("bytes", "group_size", "best.keep_id", "best.keep_row")
        out = out.unionByName(again.join(by_text, "bytes").select("row", "doc_id", "keep_id", "keep_row", "group_size", "sha"))
    return whole, out


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after every ASCII white-space character is deleted. Of equal texts the one with the
    most code points stays, then the one with the smallest doc_id. ``digest`` makes the index's key from such a text."""
    _, rows = _decided(docs.select("doc_id", "text"), digest, memtable_rows, fanout)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    whole, rows = _decided(docs, sha256, MEMTABLE_ROWS, FANOUT)
    return without(whole.select("whole", "row"), stored(rows.where("row <> keep_row").select("row"), "copies")).select("whole.*")
