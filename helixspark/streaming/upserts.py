"""A stream of vector records into a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..vector.store import VectorStore


def stream_upserts(records: DataFrame, store: VectorStore, space_id: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upserts each micro-batch of ``records``. A batch that runs again after a failure replaces its own rows, so each record counts once."""

    def upsert(batch: DataFrame, _: int) -> None:
        store.upsert(space_id, batch.persist(), dedupe=True)
        batch.unpersist()

    writer = records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
