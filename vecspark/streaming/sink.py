"""A streaming sink: each micro-batch of changes becomes one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.collection import Collection


def apply_changes(collection: Collection, changes: DataFrame) -> None:
    """Applies rows (pos, op, id, vector, maps): the last change of each id by ``pos`` counts."""
    collection.apply(changes)


def start(collection: Collection, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Applies a stream of changes. A batch that is run again after a failure upserts and deletes the same ids, and leaves
    the same live points."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_changes(collection, batch)).option("checkpointLocation", checkpoint).trigger(**(options or {"processingTime": "1 second"})).start()
