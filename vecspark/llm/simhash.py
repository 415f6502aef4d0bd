"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint bit is set if more than half of the hashes of the text's word shingles have it. Texts with one fingerprint
are one vertex. Two fingerprints within RADIUS bits agree on some set of bit blocks whatever the places of the bits that
differ (with b blocks, b - RADIUS of them), so each choice of blocks deals the fingerprints into shards by their bits there,
and every link lies within a shard. A shard is searched by a BK-tree. The number of blocks follows from the number of
fingerprints such that a shard has few of them; all choices are complete. A shard that is still larger than SHARD_ROWS is
cut into parts, and each pair of parts is searched as a shard. A shard sends on a spanning tree for each of its components
instead of all its links, and the components over all shards are joined by alternating stars.

Nulls: a null text is an empty one; without words the fingerprint is 0, and it is linked like any other. A null doc_id
counts as the largest; a group of only such rows has a null component. Repeated rows share a component. An empty table
gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.bk_tree import BkForest, _ranges
from vecspark.llm.common import bounded_batches, keyed, matching, small_batches, stored, text_of, texts, without
from vecspark.llm.components import connected_components

RADIUS, WORDS, SEED = 4, 4, 42
#: Fingerprints of one shard, beyond which it is cut into parts; and those that a task searches together at least.
SHARD_ROWS, STEP_ROWS = 50_000, 50_000
#: A shard has about so many fingerprints, if they spread evenly.
SHARD_AIM = 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    own = text.encode().translate(LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(own) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits, as a signed integer, that over half of the hashes have."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for part in np.array_split(hashes.astype("<u8"), -(-len(hashes) // 100_000)):
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""
    bounded_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fps = [fingerprint(shingle_hashes(t, words)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(found, "doc_id long, fp long")


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits such that any two fingerprints within ``radius`` agree on all bits of one mask at least, with enough
    bits for ``n`` fingerprints."""
    blocks = radius + 1
    while blocks < 64 and n / 2 ** (64 * (blocks - radius) / blocks) > SHARD_AIM and blocks < radius + 5:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(x) for x in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sharded(rows: DataFrame, keys: Column, shard_rows: int) -> DataFrame:
    """The rows once for each shard that ``keys`` (an array of structs) puts them in, large shards in pairs of parts:
    columns of ``rows`` and key, part, other."""
    dealt = rows.withColumn("key", F.explode(keys))
    large = dealt.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    return in_pairs(dealt.join(large, "key", "left"), F.xxhash64("fp")).drop("own")


def in_pairs(dealt: DataFrame, by: Column) -> DataFrame:
    """The rows once for each pair (part, other) of their shard's ``parts`` that has their own part, which is dealt by ``by``."""
    own = F.pmod(by, F.coalesce("parts", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda i: F.struct(F.least("own", i).alias("part"), F.greatest("own", i).alias("other")))
    return dealt.withColumn("own", own).withColumn("pair", F.explode(pairs)).drop("parts").select("*", "pair.*").drop("pair")


def links_within(rows: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``rows`` (fp) that have the components of all links within ``radius``."""
    masks = shard_masks(rows.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    dealt = sharded(rows.select("fp"), keys, shard_rows)
    dealt = dealt.select("fp", F.col("key.choice").alias("choice"), F.col("key.bits").alias("bits"), "part", "other")
    dealt = dealt.repartition("choice", "bits", "part", "other").sortWithinPartitions("choice", "bits", "part", "other", "fp")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, shard in whole_shards(batches, ["choice", "bits", "part", "other"], ["fp"]):
            values = fps["fp"].view(np.uint64)
            label = BkForest(values, shard).components(radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[label[linked]].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(searched, "a long, b long")


def whole_shards(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of rows sorted by ``keys``, cut only between shards, with the number of each row's shard."""
    held: list[pa.Table] = []
    size = 0

    def cut(table: pa.Table, last: bool) -> tuple[int, np.ndarray]:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return table.num_rows if last else (int(np.flatnonzero(new)[-1]) if new.any() else 0), np.cumsum(new)

    def out(table: pa.Table, shard: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {c: table.column(c).to_numpy() for c in columns}, shard

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= STEP_ROWS:
            table = pa.concat_tables(held)
            end, shard = cut(table, False)
            if end:
                yield out(table.slice(0, end), shard[:end])
            held, size = [table.slice(end)], table.num_rows - end
    if size:
        table = pa.concat_tables(held)
        end, shard = cut(table, True)
        yield out(table, shard)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest reachable doc_id)."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    owners = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    roots = connected_components(links_within(owners.select("fp"), radius, shard_rows))
    joined = owners.join(roots, owners["fp"] == roots["node"]).select("fp", "owner", "root")
    lowest = joined.groupBy("root").agg(F.min("owner").alias("component_id"))
    linked = stored(joined.join(lowest, "root").select("fp", "component_id"), "linked")
    classes = owners.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "owner").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar texts: words of a shingle, similarity from which texts are linked, bits within which fingerprints of such
#: texts lie (about 10 on average at 0.8), bands of the min-hash that deals texts into shards, and hashes of a band.
TEXT_WORDS, SIMILARITY, TEXT_RADIUS, BANDS, BAND_HASHES = 5, 0.8, 22, 14, 3
#: Shards up to this size have all their pairs within the radius verified at once. In larger ones each text is first verified
#: against its nearest neighbour and against the HUBS most central texts, and then all pairs of different components are.
ALL_PAIRS, HUBS = 24, 3
#: Texts of a part of a larger shard in the first step, where parts are searched one by one.
STEP_PART = 1024
#: Texts, and hashes of shingles, of one part of a larger shard in the second; two parts are in memory together.
PART_ROWS, PART_HASHES = 1024, 1 << 19
_rng = np.random.default_rng(12)
_FLIP, _ODD = (_rng.integers(0, 1 << 64, BANDS * BAND_HASHES, np.uint64) | np.uint64(x) for x in (0, 1))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, equal for two sets with probability similarity ** BAND_HASHES."""
    low = np.array([((hashes ^ f) * o).min() for f, o in zip(_FLIP, _ODD, strict=True)], np.uint64).reshape(BANDS, BAND_HASHES)
    key = np.zeros(BANDS, np.uint64)
    for k in range(BAND_HASHES):
        key = (key ^ (key >> np.uint64(29)) ^ low[:, k]) * _ODD[k]
    return key.view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, fp, same, size, bands) of the rows (row, doc_id, text) with words; ``same`` is a digest of the set of
    shingles, ``size`` its size."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                hashes = np.unique(shingle_hashes(text, words))
                if len(hashes):
                    rows.append((row, doc, fingerprint(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), bands_of(hashes)))
            kinds = (*[pa.int64()] * 3, pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["row", "doc_id", "fp", "same", "size", "bands"])

    return docs.mapInArrow(found, "row long, doc_id long, fp long, same binary, size long, bands array<long>")


def central(values: np.ndarray) -> np.ndarray:
    """The HUBS fingerprints that lie closest to the bitwise majority of all: copies with edits of their own lie around
    what they were made from."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0]
    return np.argsort(np.bitwise_count(values ^ middle), kind="stable")[:HUBS]


def _band_keys() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("choice"), F.element_at("bands", i + 1).alias("bits")))


def _candidates(owners: DataFrame, part_rows: int) -> DataFrame:
    """Pairs (a, b) of owners that share a band and lie within TEXT_RADIUS: all of a small shard; of a large one those that
    link most of a group soon, each text with its nearest neighbour in the shard's BK-tree and with the central ones. A
    shard of more than ``part_rows`` is dealt into parts, each searched alone, and a few of its texts are in all parts, so
    the work grows with the shard and not with its square. The other pairs of large shards are left to ``_rest``."""
    dealt = owners.select("owner", "fp", F.explode(_band_keys()).alias("key"))
    # Most keys belong to one text; they are dropped before rows are shuffled and sorted by key.
    shared = dealt.groupBy("key").agg(F.count("*").alias("members"), F.min("owner").alias("first"), F.max("owner").alias("last")).where("members > 1")
    dealt = dealt.join(shared, "key").withColumn("parts", F.ceil(F.col("members") / part_rows).cast("int"))
    dealt = dealt.withColumn("anchor", (F.col("parts") > 1) & F.col("owner").isin(F.col("first"), F.col("last")))
    own = F.pmod(F.xxhash64("owner"), F.col("parts")).cast("int")
    dealt = dealt.select("owner", "fp", "key.choice", "key.bits", "anchor", F.explode(F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part"))
    order = ["choice", "bits", "part"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "fp", "owner")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, shard in whole_shards(batches, order, ["owner", "fp", "anchor"]):
            owner, values, anchor = columns["owner"], columns["fp"].view(np.uint64), columns["anchor"]
            sizes = np.bincount(shard)[shard]
            few = np.flatnonzero((sizes <= ALL_PAIRS) & (sizes > 1))
            a, b = [], []
            for gap in range(1, ALL_PAIRS):
                low, high = few[:-gap], few[gap:]
                near = (shard[low] == shard[high]) & (np.bitwise_count(values[low] ^ values[high]) <= TEXT_RADIUS)
                a.append(owner[low[near]])
                b.append(owner[high[near]])
            # In a large shard texts with one fingerprint are a chain; the first of them stands for it in the tree.
            twin = np.flatnonzero((sizes[1:] > ALL_PAIRS) & (shard[1:] == shard[:-1]) & (values[1:] == values[:-1]))
            a.append(owner[twin])
            b.append(owner[twin + 1])
            many = np.setdiff1d(np.flatnonzero(sizes > ALL_PAIRS), twin + 1, assume_unique=True)
            own, distinct, number = owner[many], values[many], shard[many]
            at, nearest = BkForest(distinct, number).nearest_before(TEXT_RADIUS)
            a.append(own[at])
            b.append(own[nearest])
            cuts = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(many)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                shared_by_all = low + np.flatnonzero(anchor[many[low:high]])
                for hub in {*(low + central(distinct[low:high])).tolist(), *shared_by_all.tolist()}:
                    near = np.bitwise_count(distinct[low:high] ^ distinct[hub]) <= TEXT_RADIUS
                    a.append(own[low:high][near])
                    b.append(np.full(int(near.sum()), own[hub]))
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(searched, "a long, b long").where("a <> b").distinct()


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(row, hashes) of the rows (row, text) in ``needed`` (row): their sets of shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "hashes"])

    return stored(matching(docs.select("row", "text"), stored(needed, "needed")).mapInArrow(sets, "row long, hashes array<long>"), "shingle-sets")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), words)
    both = pairs.join(held.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def _open_pairs(rows: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a pair of parts with the later rows of other components that may be similar: within TEXT_RADIUS, of a
    size that allows it, with no band in common before this one and, between two parts, from the other part."""
    fp, root, own, size = (rows.column(c).to_numpy() for c in ("fp", "root", "own", "size"))
    fp, bands = fp.view(np.uint64), rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    choice, across = rows.column("choice")[0].as_py(), rows.column("part")[0].as_py() != rows.column("other")[0].as_py()
    for i in range(len(fp) - 1):
        later = slice(i + 1, None)
        may = (root[later] != root[i]) & (np.bitwise_count(fp[later] ^ fp[i]) <= TEXT_RADIUS)
        may &= np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i])
        if across:
            may &= own[later] != own[i]
        at = i + 1 + np.flatnonzero(may)
        at = at[(bands[at, :choice] != bands[i, :choice]).all(1)]
        if len(at):
            yield i, at


def _in_open_parts(linked: DataFrame, part_rows: int, part_hashes: int) -> DataFrame:
    """The rows of every large shard with several components, dealt into parts: (key, own, part, other, ...) for each pair of
    parts that may hold texts of different components.

    A component that fills a part has parts of its own, numbered after those of all other rows, and no pair of two of these
    is formed. So a shard that is one large group and a few other texts costs those texts times the parts of the group,
    and not the group's square."""
    dealt = linked.withColumn("key", F.explode(_band_keys())).withColumn("shard", F.xxhash64("key"))
    open_keys = dealt.groupBy("shard", "key").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("members") > ALL_PAIRS) & (F.col("least") < F.col("most")))
    # Few shards are open, so most rows are never shuffled.
    dealt = stored(matching(dealt, stored(open_keys.select("shard").distinct(), "open-keys"), "shard"), "in-open-shards")
    fills = lambda n, size: F.ceil(F.greatest(n / part_rows, size / part_hashes)).cast("long")
    by_root = dealt.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("sizes")).withColumn("root_parts", fills(F.col("n"), F.col("sizes")))
    large = F.col("root_parts") > 1
    shards = by_root.groupBy("key").agg(F.sum(F.when(~large, F.col("n"))).alias("n"), F.sum(F.when(~large, F.col("sizes"))).alias("sizes"))
    shards = shards.select("key", F.coalesce(fills(F.col("n"), F.col("sizes")), F.lit(0)).alias("small_parts"))
    # Components with parts of their own: each has at least part_rows texts or part_hashes hashes, so there are few.
    groups = by_root.where(large).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("root", "root_parts"))).alias("groups"))
    shards = shards.join(groups, "key", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<struct<root:bigint,root_parts:bigint>>")))
    rows = dealt.join(shards, "key")
    at = F.array_position(F.transform("groups", lambda g: g["root"]), F.col("root")).cast("int")
    before = F.aggregate(F.slice("groups", 1, F.greatest(at - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, g: s + g["root_parts"])
    all_parts = F.aggregate("groups", F.col("small_parts"), lambda s, g: s + g["root_parts"])
    rows = rows.withColumn("at", at).withColumn("start", F.when(F.col("at") > 0, F.col("small_parts") + before).otherwise(0)).withColumn("width", F.when(F.col("at") > 0, F.get("groups", F.col("at") - 1)["root_parts"]).otherwise(F.col("small_parts")))
    rows = rows.withColumn("own", F.col("start") + F.pmod(F.xxhash64("owner"), F.col("width"))).withColumn("all_parts", all_parts)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all_parts") - 1), lambda p: (F.col("at") == 0) | (p < F.col("start")) | (p >= F.col("start") + F.col("width")))
    pairs = F.transform(others, lambda p: F.struct(F.least("own", p).alias("part"), F.greatest("own", p).alias("other")))
    return rows.withColumn("pair", F.explode(pairs)).select("owner", "fp", "size", "bands", "root", "own", "key.choice", "key.bits", "pair.part", "pair.other")


def _rest(docs: DataFrame, linked: DataFrame, words: int, similarity: float, part_rows: int = PART_ROWS, part_hashes: int = PART_HASHES) -> DataFrame:
    """Edges (a, b) between components ``linked`` (owner, fp, size, bands, root) that one pair of similar texts at least joins,
    of all pairs in shards of more than ALL_PAIRS texts. A pair goes unverified only if verified links join its texts."""
    shard = ["choice", "bits", "part", "other"]
    dealt = _in_open_parts(linked, part_rows, part_hashes)

    def kept(rows: pa.Table) -> pa.Table:
        needed = np.zeros(rows.num_rows, bool)
        for i, at in _open_pairs(rows, similarity):
            needed[i] = needed[at] = True
        return rows.filter(pa.array(needed))

    # Sets go only where a pair of different components is left.
    held = stored(dealt.groupBy(*shard).applyInArrow(kept, dealt.schema), "open-shards")

    def joined(rows: pa.Table) -> pa.Table:
        lists = rows.column("hashes").combine_chunks()
        sizes, root = lists.value_lengths().to_numpy().astype(np.int64), rows.column("root").to_numpy()
        names, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        starts, label, mark = np.cumsum(sizes) - sizes, np.unique(root, return_inverse=True)[1], np.zeros(len(names), np.int64)
        a, b = [], []
        for i, at in _open_pairs(rows, similarity):
            at = at[label[at] != label[i]]
            if not len(at):
                continue
            own = ids[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids[_ranges(starts[at], sizes[at])]], np.cumsum(sizes[at]) - sizes[at])
            mark[own] = 0
            for j in at[both >= similarity * (sizes[i] + sizes[at] - both)].tolist():
                if label[j] != label[i]:
                    a.append(root[i])
                    b.append(root[j])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = _sets(docs, held.select(F.col("owner").alias("row")).distinct(), words)
    return held.join(sets, held["owner"] == sets["row"]).drop("row").groupBy(*shard).applyInArrow(joined, "a long, b long")


def _similar_rows(docs: DataFrame, words: int, similarity: float, part_rows: int) -> DataFrame:
    """(row, doc_id, component) of the rows (row, doc_id, text) with words; a component is named by one of its rows."""
    bounded_batches(docs.sparkSession)
    rows = stored(_sketches(docs, words), "sketches")
    owners = stored(rows.groupBy("same").agg(F.min("row").alias("owner")), "set-owners")
    heads = stored(rows.join(owners.select(F.col("owner").alias("row")), "row").select(F.col("row").alias("owner"), "fp", "size", "bands"), "sketch-owners")
    pairs = stored(_candidates(heads, part_rows), "candidates")
    roots = connected_components(_verified(docs, pairs, words, similarity))
    linked = stored(heads.join(roots, heads["owner"] == roots["node"], "left").select("owner", "fp", "size", "bands", F.coalesce("root", "owner").alias("root")), "linked-texts")
    # Roots are the smallest of their components, and so are those of the components joined.
    lower = connected_components(_rest(docs, linked, words, similarity)).withColumnRenamed("root", "lower")
    lowest = linked.join(lower, linked["root"] == lower["node"], "left").select("owner", F.coalesce("lower", "root").alias("component"))
    return stored(rows.select("row", "doc_id", "same").join(owners.join(lowest, "owner"), "same").select("row", "doc_id", "component"), "similar")


def similar_texts(docs: DataFrame, words: int = TEXT_WORDS, similarity: float = SIMILARITY, part_rows: int = STEP_PART) -> DataFrame:
    """(doc_id, component_id) of every row with words: the smallest doc_id that links of similar texts reach; null if all that
    it reaches are null. Rows without words are left out, and rows that repeat a doc_id are rows of their own.

    Texts are linked if the Jaccard similarity of their sets of word shingles is ``similarity`` or more. Candidates share one
    of BANDS min-hash keys, which texts at 0.8 fail to with a probability of 0.00004, and lie within TEXT_RADIUS bits by
    SimHash, found by BK-trees, which sets of 10 shingles and more at 0.8 fail to with under 0.0003, and smaller ones with
    0.0015; each candidate is verified by its whole sets. Texts with one set of shingles are one vertex.
    In a large shard each text is verified against its nearest neighbour and the most central texts first, and then every
    pair that these links leave in different components is."""
    whole = keyed(docs.select("doc_id", text_of().alias("text")), "numbered")
    rows = _similar_rows(whole.select("row", "whole.doc_id", "whole.text"), words, similarity, part_rows)
    lowest = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "component").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of similar texts, with all their columns: that with the smallest
    doc_id (null is the largest), and of equal ones the first in the table. Rows without words stay."""
    whole = keyed(docs, "numbered")
    rows = _similar_rows(whole.select("row", "whole.doc_id", text_of("whole.text").alias("text")), TEXT_WORDS, SIMILARITY, STEP_PART)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("best"))
    gone = stored(rows.join(best, "component").where("row <> best").select("row"), "near-copies")
    return without(whole, gone).select("whole.*")
