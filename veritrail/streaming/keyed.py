"""Extension: the keyed store fed by a stream, and keep-last state inside a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import append_dedup


def stream_into_store(stream: DataFrame, store_path: str, keys: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch goes through ``append_dedup``; a batch that is replayed changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        append_dedup(batch, store_path, keys, verbose=False)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_by_key(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The freshest row of every key as streaming state (output mode update or complete)."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), F.col(order)).alias("row")).select(*keys, "row.*")
