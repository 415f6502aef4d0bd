"""Token ids as directly addressable codes: a binary format with random access to any token.

Each id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, and a bitmap that says which ids
go on; level 1 holds the next chunk of only those, and so on. A directory with the number of set bits before every
BLOCK-th position turns a position of one level into that of the next, so token i is found with one look-up for each
chunk, and no block is decoded. A run of tokens is also a run on each level, which makes sequential reads fast.

A file is a Parquet folder, so that any store Spark writes to will do and a task's output counts only once it is
committed. Its rows are segments in ascending doc_id order; a segment is one binary value, described at ``Segment``, with
about SEGMENT_TOKENS tokens of whole documents (a longer document has its own). Rows also tell how many tokens of the
same part come before, so that a few counts, one for each part, give every document's place in the stream. Parts are
ranges of doc_id whose bounds come from a scan of that column alone, so texts are read and shuffled once; a doc_id that fills
several parts is dealt over them.

Nulls: a null text is an empty one and has the end id only; a null doc_id comes first. Documents with equal doc_id come in
any order. The strings of special tokens in a text are those tokens, as the library has it. An empty table gives an empty
file. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import bounded_batches, small_batches, text_of, texts

SEGMENT_TOKENS = 1 << 20
BLOCK = 512
#: Parts for each partition of a shuffle: a few, so that partitions, which get parts by a hash, are about equal.
PARTS = 4
MAGIC = b"DACS"
_HEAD = struct.Struct("<4sIQI")
ROW = "part int, segment int, tokens_before long, first_doc long, last_doc long, n_docs int, n_tokens long, payload binary"


def encode_levels(ids: np.ndarray) -> bytes:
    """All levels of the ids: per level a count, then bitmap, directory and chunks; the last level has no set bit."""
    out, values = [], ids.astype(np.uint32)
    while True:
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.int64)
        directory = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4") if len(per_block) else np.zeros(0, "<u4")
        out += [struct.pack("<Q", len(values)), bits.tobytes(), directory.tobytes(), values.astype(np.uint8).tobytes()]
        values = (values >> 8)[more]
        if not len(values):
            return b"".join(out)


class Segment:
    """Reads one segment: magic, documents, tokens, levels; doc_ids (signed 64 bits), whether each is null (bytes), end of
    each document (64 bits), then the levels."""

    def __init__(self, payload: bytes):
        magic, docs, self.n_tokens, _ = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
        self.ends = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.levels = []
        while at < len(payload):
            (n,) = struct.unpack_from("<Q", payload, at)
            n_bytes, n_blocks = -(-n // 8), -(-n // BLOCK)
            bits = np.frombuffer(payload, np.uint8, n_bytes, at + 8)
            directory = np.frombuffer(payload, "<u4", n_blocks, at + 8 + n_bytes)
            self.levels.append((np.frombuffer(payload, np.uint8, n, at + 8 + n_bytes + 4 * n_blocks), bits, directory))
            at += 8 + n_bytes + 4 * n_blocks + n

    @staticmethod
    def pack(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
        head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), 0)
        parts = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(ends, "<u8").tobytes()]
        return b"".join([*parts, encode_levels(ids)])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, bits, directory = self.levels[level]
        if i >= len(self.levels[level][0]):
            return int(directory[-1]) + int(np.bitwise_count(bits[(len(directory) - 1) * BLOCK // 8 :]).sum()) if len(directory) else 0
        block, byte = i // BLOCK, i // 8
        return int(directory[block]) + int(np.bitwise_count(bits[block * BLOCK // 8 : byte]).sum()) + int(bits[byte] & ((1 << i % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("the last level goes on")

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1, as unsigned 32-bit integers."""
        out, at = np.zeros(end - start, "<u4"), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start == end:
                break
            part = chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            if at is None:
                out[:] = part
            else:
                out[at] |= part
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            at = np.flatnonzero(more) if at is None else at[more]
            start = self._rank(level, start)
            end = start + len(at)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, tokens of the segment before it, and its ids."""
        ids, start = self.tokens(0, self.n_tokens), 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else doc, start, ids[start:end]
            start = end


def range_part(docs: DataFrame, parts: int) -> Column:
    """The number of each row's part, ascending with doc_id, nulls first, with about equally many rows a part."""
    found = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("bounds")).first()
    nulls = max(1, round(parts * (found.n - found.known) / max(1, found.n)))
    bounds = found.bounds or []
    # Two steps of about the square root of the number of parts each.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    literal = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    doc, salt = F.col("doc_id"), F.xxhash64(F.monotonically_increasing_id())
    below = lambda values: F.size(F.filter(values, lambda b: b < doc))
    # Groups whose last bound is below the row's doc_id are below it as a whole.
    whole = below(literal([g[-1] for g in groups]))
    inside = F.coalesce(below(F.get(F.array(*map(literal, groups)), whole)), F.lit(0))
    # A doc_id that fills parts has as many equal bounds; its rows are dealt over these parts.
    hot = {b: n for b, n in Counter(bounds).items() if n > 1}
    equal = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in hot.items() for x in pair]), doc), F.lit(1)) if hot else F.lit(1)
    known = F.lit(nulls) + whole * step + inside + F.pmod(salt, equal)
    return F.when(doc.isNull(), F.pmod(salt, F.lit(nulls))).otherwise(known).cast("int")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every whole text, appends ``end_id``, and writes the ids below ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vecspark.llm.tokens import shared_tokenizer

        encoder, end = shared_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part = done = number = 0
        names: list[int | None] = []
        ends: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, number, names, ends, held
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [part, number, done, names[0], names[-1], len(names), len(ids), Segment.pack(names, ends, ids)]
            done, number, names, ends, held = done + len(ids), number + 1, [], [], []
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in ROW.split(", ")])

        for batch in small_batches(batches, "text"):
            for doc, own, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts(batch, "text"), strict=True):
                if own != part:
                    if names:
                        yield flush()
                    part, done, number = own, 0, 0
                ids = encoder.encode(text) + end
                names.append(doc)
                held.append(ids)
                ends.append((ends[-1] if ends else 0) + len(ids) // 4)
                if ends[-1] >= segment_tokens:
                    yield flush()
        if names:
            yield flush()

    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of().alias("text"), range_part(docs, parts).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(segments, ROW).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    bounded_batches(spark)
    rows = spark.read.schema(ROW).parquet(path)
    # One row for each part that was written, that is for each task: far fewer than documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.max(F.col("tokens_before") + F.col("n_tokens")).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, done, payload in zip(batch.column("part").to_pylist(), batch.column("tokens_before").to_pylist(), batch.column("payload"), strict=True):
                found = [(doc, done + start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in Segment(payload.as_py()).documents()]
                columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *columns], names=["part", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = rows.select("part", "tokens_before", "payload").mapInArrow(documents, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, doc_id: int, position: int) -> int | None:
    """One token of one document: the segment is found by its bounds, the token by its address."""
    rows = spark.read.schema(ROW).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("payload")
    for row in rows.toLocalIterator():
        segment = Segment(bytes(row.payload))
        for i in np.flatnonzero((segment.doc_ids == doc_id) & (segment.null == 0)).tolist():
            start = int(segment.ends[i - 1]) if i else 0
            if 0 <= position < segment.ends[i] - start:
                return segment.token(start + position)
    return None
