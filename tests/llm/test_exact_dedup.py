import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from vecspark.llm.exact_dedup import DigestIndex, drop_copies, exact_dedup, sha256

SCHEMA = "doc_id long, text string, n long, digest string, keep_id string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return sorted((doc_id, min(g)[1], len(g), doc_id == min(g)[1], hashlib.sha256(key.encode()).hexdigest()) for key, g in groups.items() for _, doc_id in g)


ROWS = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, " \t\x0b"), (7, "A B"), (8, "é" * 5), (9, "é é" + "é" * 3), (10, "x" * 200_000), (11, "x " * 200_000), (12, "a b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "d", "k") for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_equals_brute_force(spark):
    assert got(exact_dedup(frame(spark, ROWS))) == brute(ROWS)


def test_batches_and_compaction(spark):
    rows = ROWS + [(100 + i, "copy") for i in range(40)]
    for memtable_rows, fanout in ((1, 2), (3, 4), (5, 100)):
        assert got(exact_dedup(frame(spark, rows), memtable_rows=memtable_rows, fanout=fanout)) == brute(rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = ROWS + [(100 + i, f"t{i % 7}") for i in range(50)]
    assert got(exact_dedup(frame(spark, rows), digest=lambda t: F.substring(sha256(t), 1, 1))) == brute(rows)


def test_empty_and_hot(spark):
    assert got(exact_dedup(frame(spark, []))) == []
    rows = [(i, "same  text" if i % 3 else f"other {i}") for i in range(9000)]
    assert got(exact_dedup(frame(spark, rows))) == brute(rows)


def test_null_and_repeated_ids(spark):
    out = got(exact_dedup(frame(spark, [(None, "q"), (1, "q"), (2, "r"), (2, "r")])).fillna(-1))
    assert [(r[0], r[1], r[2], r[3]) for r in out] == [(-1, -1, 2, True), (1, -1, 2, False), (2, 2, 2, False), (2, 2, 2, True)]


def test_levels_merge(spark):
    rows = [(i, 10 - i, 5, b"d" if i % 2 else b"e%d" % i) for i in range(10)] + [((1 << 33) + i, 50 + i, 5 + i, b"d") for i in range(3)]
    index = DigestIndex(spark.createDataFrame(rows, "row long, doc_id long, points int, digest binary"), memtable_rows=2, fanout=2)
    assert index.runs == [7, 5, 3, 2, 1]  # five runs of ten rows, two of three
    entries = {bytes(r.digest): (r.n, r.points, r.keep_id, r.keep_row) for r in index.entries.collect()}
    assert entries[b"d"] == (8, 7, 52, (1 << 33) + 2) and entries[b"e4"] == (1, 5, 6, 4) and [bytes(r.digest) for r in index.hits().collect()] == [b"d"]


def test_one_row_of_each_group_stays(spark):
    rows = [(0, "same text", 0), (1, "sametext", 1), (1, "unique text", 2), (5, "rep", 3), (5, "rep", 4), (None, "nn", 5), (None, "nn", 6), (None, None, 7), (8, " ", 8), (9, "", 9)]
    docs = spark.createDataFrame([(d, t, i, "x") for d, t, i in rows], "doc_id long, text string, row long, whole string").coalesce(1)
    left = drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == [0, 2, 3, 5, 8]
    assert drop_copies(docs.limit(0)).collect() == []
