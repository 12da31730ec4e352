"""Incremental ingest: micro-batches of rows merged into a vector table, last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.operators.vector_table import VectorTable


def stream_upserts(rows: DataFrame, table: VectorTable, checkpoint: str, key: str = "chunk_id", order: str = "version"):
    """Start the query; rows is a streaming DataFrame with key, vector and order."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, key, order)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
