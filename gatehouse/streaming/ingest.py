"""Streaming ingestion: every micro-batch becomes one version of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Chunking
from ..operators.ingest import EmbedChunks, ingest
from ..plans.tables import Tables


def stream_ingest(raw: DataFrame, tables: Tables, embed: EmbedChunks, checkpoint: str, *, rules: Chunking | None = None, seq: str | None = None) -> StreamingQuery:
    """Start a query over a stream of schemas.RAW rows; it ends when what is there is done.

    A batch that is run again after a failure finds its documents unchanged and
    publishes nothing, so each document's version is published once.
    """

    def publish(batch: DataFrame, _: int) -> None:
        ingest(tables, batch, embed, rules=rules, seq=seq)

    return raw.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
