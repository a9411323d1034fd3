"""Incremental ingestion: patches that arrive as files go into the cube, each once, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.cube import Cube


def ingest_stream(cube: Cube, path: str, checkpoint: str, files_per_batch: int = 16, available_now: bool = True) -> StreamingQuery:
    """Watch a folder of Parquet files with patch_id, it, iy, ix and the channels.

    A batch that runs again after a failure commits nothing twice, for a patch is written at most once. Patches that come
    late fill the holes they were meant for; where patches do not overlap, the order of arrival does not matter.
    """
    schema = "patch_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cube.definition.cell_schema().fields)
    cells = cube.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            cube.store.write_patches(held.select("patch_id").distinct().orderBy("patch_id"), held, f"Batch {number}")
        finally:
            held.unpersist()

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
