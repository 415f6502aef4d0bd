"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: UTF-8 bytes of text that one step of a Python operator handles together.
BATCH_BYTES = 4_000_000


#: Paths that were handed out and not deleted since.
_written: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which the driver and all executors share.

    A temporary folder takes its place only where that setting is missing and Spark runs on this machine alone, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    _written.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts the lineage so that a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str, **more: Column) -> DataFrame:
    """(row, whole, ...): the rows written once with a number each, so that later steps name a row whatever its doc_id;
    ``whole`` holds all their columns, and ``more`` are computed from these."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in more.items()])
    return stored(numbered, name, compression="zstd")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written to the shared folder within, once it has ended without an error."""
    before = set(_written)
    yield
    for path in [p for p in _written if p not in before]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _written.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python are cut by bytes, not by rows alone, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without_space(text: Column) -> Column:
    """The text less every ASCII white-space character."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of about BATCH_BYTES of ``column`` each (one row at least), so that memory is bounded by
    the longest row and not by a batch of long rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


#: Bits of a broadcast filter, at least and at most: 32 MB, whatever the input. A filter lets through all rows it was made of,
#: and others as it fills up.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


class BitFilter:
    """A bitmap over the hashes of a column of ``rows``, which should be written rows, with about 16 bits for each."""

    def __init__(self, rows: DataFrame, key: str):
        self.key = key
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rows.count()).bit_length()))
        slot = self._slot()
        self.bitmap = rows.groupBy(F.bitmap_bucket_number(slot).alias("filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("filter_bits"))

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.bits))

    def marked(self, rows: DataFrame) -> DataFrame:
        """The rows with ``in_filter``: false only if the key is surely not among those of the filter."""
        at = rows.withColumn("filter_at", F.bitmap_bit_position(self._slot()))
        joined = at.join(F.broadcast(self.bitmap), F.bitmap_bucket_number(self._slot()) == F.col("filter_bucket"), "left")
        byte = F.conv(F.hex(F.expr("substring(filter_bits, cast(filter_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.getbit(byte, F.pmod("filter_at", F.lit(8)).cast("int"))
        return joined.withColumn("in_filter", F.coalesce(bit == 1, F.lit(False))).drop("filter_bucket", "filter_bits", "filter_at")

    def passing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key may be in the filter."""
        return self.marked(rows).where("in_filter").drop("in_filter")


def matching(rows: DataFrame, ids: DataFrame, key: str = "row") -> DataFrame:
    """The rows whose key is among ``ids``. Texts of few other rows are shuffled."""
    return BitFilter(ids, key).passing(rows).join(ids, key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str = "row") -> DataFrame:
    """The rows whose key is not among ``ids``. Only rows that may be among them are shuffled."""
    either = BitFilter(ids, key).marked(rows)
    return either.where("not in_filter").union(either.where("in_filter").join(ids, key, "left_anti").select(either.columns)).drop("in_filter")
