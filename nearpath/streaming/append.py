"""Incremental index: signatures depend on one trajectory only, so the index is an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearpath.functions.lsh import Family
from nearpath.operators.collide import signatures


def append_signatures(curves: DataFrame, family: Family, table: str, checkpoint: str, once: bool = False):
    """Start a query that appends the signatures of arriving trajectories (a streaming frame id, pts).

    Each micro-batch is written once: a batch that is run again overwrites its own folder.  ``once`` ends
    the query when all that has arrived is appended.
    """

    def write(batch: DataFrame, number: int) -> None:
        signatures(batch, family).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = curves.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
