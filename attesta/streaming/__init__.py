"""Event logs as streams: the last action of each key as keyed state with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources import workspace


def last_action_stream(events: DataFrame, key: str, *order: str) -> DataFrame:
    """A streaming frame of the last event of each key (complete or update mode)."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))


def run_once(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Drives a stream over all that is available. Each batch writes the whole state as a table below the shared folder,
    beside the checkpoint, so a rerun over the same folder goes on where the last one ended; the last table is returned."""
    spark = stream.sparkSession
    to = folder or workspace(spark, label)
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        last[:] = [f"{to}/state-{number}"]
        batch.write.mode("overwrite").parquet(last[0])

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
