import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.config import CollectionConfig, DurabilityConfig, FilterConfig, HnswParams, SearchParams
from vecspark.errors import CollectionExistsError, CollectionNotFoundError, LogCorruptedError, SnapshotCorruptedError
from vecspark.functions import vector as V
from vecspark.manager import CollectionManager
from vecspark.operators import changes
from vecspark.sources.store import Files, Manifests, decode, encode
from vecspark.streaming import sink


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "data")


def ids(response):
    return [h.id for h in response.hits]


def test_two_points(spark, root):
    c = CollectionManager(spark, root).create(CollectionConfig.flat("two", 2))
    c.upsert([("a", [0, 0], {"lang": "ta", "year": 2020, "ok": True}), ("b", [5, 5], None)])
    found = c.search([1, 1], 5)
    assert ids(found) == ["a", "b"] and found.hits[0].score == 2 and found.strategy == "UNFILTERED" and found.selectivity == 1
    assert found.hits[0].metadata == {"lang": "ta", "year": 2020.0, "ok": True}
    assert c.search([1, 1], 5, where={"field": "lang", "eq": "hi"}).strategy == "NO_MATCH"
    c.upsert([("a", [10, 10], {})])
    again = c.search([0, 0], 1, where={"field": "lang", "eq": "ta"})
    assert again.hits == [] and c.search([0, 0], 2).hits[1].score == 200
    assert c.stats()["tombstones"] == 0 and c.stats()["compactions"] == 1  # one of three versions was dead


def test_repeated_ids_keep_the_last(spark, root):
    c = CollectionManager(spark, root, DurabilityConfig(compact_above=1.0)).create(CollectionConfig.flat("rep", 1))
    c.upsert([("a", [1], None), ("b", [2], None), ("a", [3], None)])
    assert (c.get("a").vector, c.get("a").ord, c.stats()["live"], c.stats()["tombstones"]) == ([3.0], 2, 2, 1)
    assert c.get("zz") is None and c.delete("zz") == [False] and c.last_lsn == 4
    assert c.delete("a", "b", "a") == [True, True, False] and c.stats()["live"] == 0 and c.search([0], 3).hits == []


@pytest.mark.parametrize(("point", "message"), [(("x", [1.0], None), "dim 1, expected 2"), (("x", [1, float("nan")], None), "not finite"), (("", [1, 2], None), "an id needs"), (("y" * 257, [1, 2], None), "an id needs"), (("x", [0, 0], None), "zero"), (("x", [1, 2], {"a": None}), "metadata")])
def test_batches_are_all_or_nothing(spark, root, point, message):
    c = CollectionManager(spark, root).create(CollectionConfig.flat("strict", 2, "COSINE"))
    with pytest.raises(ValueError, match=message):
        c.upsert([("ok", [3, 4], None), point])
    assert c.stats()["live"] == 0 and c.last_lsn == 1
    c.upsert([("ok", [3, 4], None)])
    assert np.allclose(c.get("ok").vector, [0.6, 0.8])


def test_compaction_at_the_twenty_first_delete(spark, root):
    c = CollectionManager(spark, root).create(CollectionConfig.flat("gone", 1))
    c.upsert([(f"p{i}", [i], None) for i in range(100)])
    c.delete(*[f"p{i}" for i in range(20)])
    assert (c.stats()["tombstones"], c.stats()["compactions"]) == (20, 0)
    c.delete("p20")
    assert (c.stats()["tombstones"], c.stats()["live"], c.stats()["compactions"]) == (0, 79, 1)
    rows = c.points().orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(79)) and [r.id for r in rows] == [f"p{i}" for i in range(21, 100)]
    remap = {r.ord: r.new_ord for r in c.compact().collect()}
    assert remap == {i: i for i in range(79)} and c.stats()["compactions"] == 2


def test_strategies(spark, root):
    c = CollectionManager(spark, root).create(CollectionConfig.with_hnsw("plan", 8))
    rng = np.random.default_rng(1)
    many = rng.normal(size=(1000, 8)).astype(np.float32)
    c.upsert([(f"p{i}", v.tolist(), {"bucket": i % 100, "half": i % 2 == 0}) for i, v in enumerate(many)])
    c.build_index(400)
    q = rng.normal(size=8)
    few, half = c.search(q, 5, where={"field": "bucket", "eq": 7}), c.search(q, 5, where={"field": "half", "eq": True})
    assert (few.strategy, few.selectivity) == ("EXACT_SCAN", 0.01) and (half.strategy, half.selectivity) == ("FILTERED_INDEX", 0.5)
    assert c.search(q, 5, where={"field": "bucket", "eq": 1000}).strategy == "NO_MATCH"
    d = V.distances("L2", many, q.astype(np.float32))
    assert ids(few) == [f"p{i}" for i in sorted(range(7, 1000, 100), key=lambda i: d[i])[:5]]
    assert len(set(ids(half)) & {f"p{i}" for i in sorted(range(0, 1000, 2), key=lambda i: d[i])[:5]}) >= 4
    # Points after the index was built are found, and deleted ones aren't.
    c.upsert([("new", q.tolist(), {"half": True})])
    c.delete(ids(half)[0])
    after = ids(c.search(q, 5))
    assert after[0] == "new" and ids(half)[0] not in after
    odd = c.search(q, 5, where={"field": "half", "eq": True}, also=F.col("ord") % 4 == 0)
    assert odd.strategy == "FILTERED_INDEX" and all(i == "new" or int(i[1:]) % 4 == 0 for i in ids(odd)) and c.is_durable
    plan, _ = c.plan(5, SearchParams(), {"field": "half", "eq": True})
    assert plan.ef == 64 * 2


def test_limits(spark, root):
    c = CollectionManager(spark, root).create(CollectionConfig.flat("lim", 1))
    for k in (0, 10_001):
        with pytest.raises(ValueError):
            c.search([1], k)
    with pytest.raises(ValueError):
        c.search([1], 1, SearchParams(10_001))
    with pytest.raises(ValueError):
        c.search([1, 2], 1)
    for make in (lambda: SearchParams(-1), lambda: CollectionConfig("bad name", 1), lambda: CollectionConfig("x", 0), lambda: CollectionConfig("x", 4097), lambda: CollectionConfig("x", 1, "MANHATTAN"), lambda: CollectionConfig("x", 1, "L2", "TREE"),
                 lambda: DurabilityConfig(snapshot_every=-1), lambda: DurabilityConfig(keep_snapshots=0), lambda: FilterConfig(exact_below=2), lambda: FilterConfig(max_ef=0)):
        with pytest.raises(ValueError):
            make()


def test_manager(spark, root):
    m = CollectionManager(spark, root)
    m.create(CollectionConfig.flat("b", 1))
    m.create(CollectionConfig.with_hnsw("A", 2, "DOT", HnswParams(m=4)))
    with pytest.raises(CollectionExistsError):
        m.create(CollectionConfig.flat("a", 1))
    assert m.names() == ["A", "b"] and [r.name for r in m.stats().collect()] == ["A", "b"]
    with pytest.raises(CollectionNotFoundError):
        m.get("zz")
    m.drop("b")
    with pytest.raises(CollectionNotFoundError):
        m.drop("b")
    files = Files(spark, root)
    files.mkdirs("half-made")  # a create without a manifest
    files.mkdirs("x.dropped-1")
    again = CollectionManager(spark, root)
    assert again.names() == ["A"] and files.names() == ["A"] and again.get("A").config.hnsw.m == 4
    again.close()
    assert again.names() == []
    memory = CollectionManager(spark)
    memory.create(CollectionConfig.flat("m", 1)).upsert([("a", [1], None)])
    assert ids(memory.get("m").search([1], 1)) == ["a"]


def state(c):
    return sorted((r.id, r.vector, r.ord, str(sorted(r.meta_num.items()))) for r in c.points().collect())


def test_recovery_equals_a_model(spark, root):
    rng, model = random.Random(3), {}
    c = CollectionManager(spark, root).create(CollectionConfig.flat("model", 2))
    for step in range(14):
        if rng.random() < 0.3 and model:
            gone = rng.sample(sorted(model), min(len(model), 3))
            assert c.delete(*gone, "absent") == [True] * len(gone) + [False]
            for g in gone:
                del model[g]
        else:
            batch = [(f"p{rng.randrange(15)}", [rng.random(), rng.random()], {"step": step}) for _ in range(rng.randint(1, 6))]
            c.upsert(batch)
            model |= {i: (np.float32(v).tolist(), m) for i, v, m in batch}
        if step in (5, 9):
            c.snapshot()
        assert c.stats()["live"] == len(model)
    assert {r.id: (r.vector, {k: v for k, v in r.meta_num.items()}) for r in c.points().collect()} == {i: (v, {"step": float(m["step"])}) for i, (v, m) in model.items()}
    back = CollectionManager(spark, root).get("model")
    assert state(back) == state(c) and back.last_lsn == c.last_lsn and back.stats() == c.stats()
    back.upsert([("after", [1, 1], None)])
    assert back.last_lsn == c.last_lsn + 1
    with pytest.raises(FileExistsError):  # a second writer on the old version
        c.upsert([("other", [1, 1], None)])
    assert "other" not in {r.id for r in CollectionManager(spark, root).get("model").points().collect()}


def test_damage(spark, root):
    c = CollectionManager(spark, root, DurabilityConfig(compact_above=1.0)).create(CollectionConfig.flat("dmg", 1))
    c.upsert([("a", [1], None)])
    before = state(c)
    c.upsert([("b", [2], None)])
    files = Files(spark, root)
    names = [n for n in files.names("dmg") if n.startswith("manifest-")]
    newest = files.read(f"dmg/{names[-1]}")
    for damaged in (newest[:-5], newest.replace(b'\\"live\\": 2', b'\\"live\\": 3'), b"", b"garbage"):
        files.delete(f"dmg/{names[-1]}")
        files.write(f"dmg/{names[-1]}", damaged)
        assert state(CollectionManager(spark, root).get("dmg")) == before
    files.delete(f"dmg/{names[-1]}")
    files.write(f"dmg/{names[-1]}", newest)
    c.verify()
    files.delete(f"dmg/{c.manifest['segments'][-1]['path']}")  # what the newest version lists is gone
    assert state(CollectionManager(spark, root).get("dmg")) == before
    c.manifest["segments"][0]["rows"] = 9
    with pytest.raises(LogCorruptedError):
        c.verify()
    for n in names:
        files.delete(f"dmg/{n}")
        files.write(f"dmg/{n}", b"{}")
    with pytest.raises(SnapshotCorruptedError):
        CollectionManager(spark, root)


def test_pruning_and_automatic_snapshots(spark, root):
    c = CollectionManager(spark, root, DurabilityConfig(snapshot_every=3, keep_snapshots=2)).create(CollectionConfig.flat("auto", 1))
    for i in range(12):
        c.upsert([(f"p{i}", [i], None)])
    names = Files(spark, root).names("auto")
    assert len([n for n in names if n.startswith("snapshot-")]) == 2 and c.manifest["snapshot"]["lsn"] >= 10 and c.points().count() == 12
    alive = set(Manifests.listed(c.manifest))
    assert alive <= set(names) and decode(encode(c.manifest)) == c.manifest


def test_change_operators(spark):
    log = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, "c"), (5, 1, "b"), (6, 3, "zz")], "lsn long, op int, id string")
    assert sorted((r.id, r.lsn) for r in changes.latest(log).collect()) == [("b", 5), ("c", 4)]
    row = changes.counters(log).first()
    assert (row.stored, row.live, row.tombstones, row.tombstone_ratio) == (4, 2, 2, 0.5) and changes.counters(log.limit(0)).first().tombstone_ratio == 0
    assert not changes.needs_compaction(2, 10) and changes.needs_compaction(21, 100) and not changes.needs_compaction(0, 0)
    versions = spark.createDataFrame([(i, i % 3 != 0) for i in range(20)], "ord long, live boolean")
    got = dict(map(tuple, changes.remap(versions).collect()))
    live = [i for i in range(20) if i % 3]
    assert got == {i: live.index(i) if i in live else -1 for i in range(20)}


def test_dense_order_over_parts(spark, monkeypatch):
    monkeypatch.setattr(changes, "RANGE_ROWS", 70)
    rng = random.Random(1)
    values = rng.sample(range(100_000), 500)
    got = changes.dense_order(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n", 5).collect()
    assert {r.v: r.n for r in got} == {v: 5 + i for i, v in enumerate(sorted(values))}


def test_stream(spark, root, tmp_path):
    c = CollectionManager(spark, root).create(CollectionConfig.flat("stream", 1))
    rows = [(1, 1, "a", [1.0]), (2, 1, "b", [2.0]), (3, 2, "a", None), (4, 1, "c", [3.0])]
    source = str(tmp_path / "in")
    maps = [F.create_map().cast(t).alias(n) for n, t in (("meta_str", "map<string,string>"), ("meta_num", "map<string,double>"), ("meta_bool", "map<string,boolean>"))]
    frame = spark.createDataFrame(rows, "pos long, op int, id string, vector array<float>").select("*", *maps)
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    q = sink.start(c, stream, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert {r.id for r in c.points().collect()} == {"b", "c"}
    sink.apply_changes(c, spark.createDataFrame([(9, 2, "b", None)], "pos long, op int, id string, vector array<float>").select("*", *maps))
    assert {r.id for r in c.points().collect()} == {"c"}


def test_small_commits_leave_few_segments(spark, root):
    durability = DurabilityConfig(snapshot_every=0, merge_segments=3, compact_above=1.0)
    c = CollectionManager(spark, root, durability).create(CollectionConfig.flat("many", 1))
    for i in range(7):
        c.upsert([(f"p{i % 5}", [i], None)])
    assert len(c.manifest["segments"]) < 4 and [s["from"] for s in c.manifest["segments"]][0] == 2 and c.manifest["segments"][-1]["to"] == c.last_lsn == 8
    c.verify()
    again = CollectionManager(spark, root, durability).get("many")
    assert state(again) == state(c) and {r.id: r.vector for r in again.points().collect()} == {"p0": [5.0], "p1": [6.0], "p2": [2.0], "p3": [3.0], "p4": [4.0]}


def test_graphs_come_grow_and_survive_compaction(spark, root):
    durability = DurabilityConfig(index_every=150, compact_above=0.2)
    c = CollectionManager(spark, root, durability).create(CollectionConfig.with_hnsw("life", 6, "DOT"))
    rng = np.random.default_rng(4)
    many = rng.normal(size=(400, 6)).astype(np.float32)
    add = lambda a, b: c.upsert([(f"p{i}", many[i].tolist(), {"half": i % 2 == 0}) for i in range(a, b)])
    add(0, 100)
    assert c.manifest["indexes"] == [] and c.search(many[0], 3, where={"field": "half", "eq": True}).strategy == "EXACT_SCAN"
    add(100, 250)
    add(250, 399)
    add(399, 400)
    assert [(x["from"], x["below"], x["rows"]) for x in c.manifest["indexes"]] == [(0, 250, 250), (250, 400, 150)]
    assert c.search(many[0], 3, where={"field": "half", "eq": True}).strategy == "FILTERED_INDEX"
    queries = spark.createDataFrame([(i, many[i].tolist()) for i in range(0, 400, 20)], "qid long, vector array<float>")

    def share():
        live = {r.id for r in c.points().select("id").collect()}
        got = {}
        for r in c.search_many(queries, 5, SearchParams(ef=100))[0].collect():
            got.setdefault(r.qid, set()).add(r.id)
        found = 0
        for qid in range(0, 400, 20):
            order = np.argsort(V.distances("DOT", many, many[qid]), kind="stable")
            found += len(got[qid] & set([f"p{i}" for i in order if f"p{i}" in live][:5]))
        return found / 100

    assert share() >= 0.95
    c.delete(*[f"p{i}" for i in range(1, 200, 2)])
    assert c.stats()["compactions"] == 1 and [(x["from"], x["below"], x["rows"]) for x in c.manifest["indexes"]] == [(0, 300, 300)]
    assert share() >= 0.95 and CollectionManager(spark, root).get("life").manifest["indexes"] == c.manifest["indexes"]


def test_a_batch_of_changes_is_one_commit(spark, root):
    c = CollectionManager(spark, root, DurabilityConfig(compact_above=1.0)).create(CollectionConfig.flat("one", 1))
    c.upsert([("a", [1], None), ("b", [2], None)])
    version = c.manifest["version"]
    maps = [F.create_map().cast(t).alias(n) for n, t in (("meta_str", "map<string,string>"), ("meta_num", "map<string,double>"), ("meta_bool", "map<string,boolean>"))]
    rows = [(1, 1, "a", [9.0]), (2, 2, "b", None), (3, 2, "absent", None), (4, 1, "c", [3.0]), (5, 2, "a", None), (6, 1, "a", [4.0])]
    c.apply(spark.createDataFrame(rows, "pos long, op int, id string, vector array<float>").select("*", *maps))
    assert c.manifest["version"] == version + 1 and {r.id: r.vector for r in c.points().collect()} == {"a": [4.0], "c": [3.0]} and c.stats()["live"] == 2 and c.last_lsn == 6
    with pytest.raises(ValueError, match="not finite"):
        c.apply(spark.createDataFrame([(1, 2, "a", None), (2, 1, "z", [float("nan")])], "pos long, op int, id string, vector array<float>").select("*", *maps))
    assert c.stats()["live"] == 2


def test_damaged_data(spark, root):
    import pathlib

    c = CollectionManager(spark, root, DurabilityConfig(compact_above=1.0)).create(CollectionConfig.flat("bits", 4))
    c.upsert([("a", [1, 2, 3, 4], None)])
    before = state(c)
    c.upsert([(f"p{i}", [i, i + 0.5, 1, 2], None) for i in range(50)])
    c.verify()
    folder = pathlib.Path(root, "bits", c.manifest["segments"][-1]["path"])
    for part in folder.glob("*.parquet"):
        whole = part.read_bytes()
        part.write_bytes(whole[:40] + bytes([whole[40] ^ 255]) + whole[41:])
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(LogCorruptedError):
        c.verify()
    for part in folder.glob("*.parquet"):
        part.write_bytes(part.read_bytes() + b"x")
    assert state(CollectionManager(spark, root).get("bits")) == before  # the newest version's sizes differ, so the older one counts


def test_other_kinds_of_index(spark, root):
    from vecspark import config
    from vecspark.operators import ann
    from vecspark.operators.hnsw import HnswGraph

    class Plain(HnswGraph):
        """Scans its shard."""

        def search(self, q, k, ef=0, eligible=None):
            at = np.arange(len(self.ords)) if eligible is None else np.flatnonzero(eligible)
            d = V.distances(self.metric, self.vectors[at], q)
            order = np.lexsort((self.ords[at], d))[:k]
            return self.ords[at][order], d[order]

    ann.register("PLAIN", Plain)
    try:
        c = CollectionManager(spark, root).create(CollectionConfig("own", 3, "L2", "PLAIN"))
        many = np.random.default_rng(2).normal(size=(60, 3)).astype(np.float32)
        c.upsert([(f"p{i}", v.tolist(), None) for i, v in enumerate(many)])
        c.build_index(25)
        d = V.distances("L2", many, many[7])
        assert ids(c.search(many[7], 10)) == [f"p{i}" for i in np.argsort(d, kind="stable")[:10]] and c.manifest["indexes"][0]["shards"] == 3
    finally:
        del ann.KINDS["PLAIN"]
        config.INDEXES.discard("PLAIN")
