"""Outlets as a stream: every micro-batch is delineated as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.delineate import Options, delineate_batch
from ..sources.fabric import Fabric


def delineate_stream(fabric: Fabric, outlets: DataFrame, path: str, checkpoint: str, options: Options | None = None, **trigger) -> StreamingQuery:
    """Starts a query that appends the basins of a streaming table (outlet_id, lat, lon) to Parquet under path, a folder for
    each batch, so that a batch that runs again after a failure replaces its own rows. The fabric does not change: no
    state is needed."""

    def each(batch: DataFrame, number: int) -> None:
        delineate_batch(fabric, batch, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return outlets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
