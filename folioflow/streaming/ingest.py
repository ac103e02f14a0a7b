"""Incremental ingest: new files of a landing folder, by a streaming binaryFile source."""

from __future__ import annotations

from folioflow.plans.engine import Engine
from folioflow.sources import files


def ingest_new(engine: Engine, landing: str, checkpoint: str, files_per_batch: int = 1000):
    """Every file that arrived since the last call, in batches; returns the finished query.

    A batch that is run again after a failure finds its documents in the store and adds nothing."""

    def put(batch, _epoch) -> None:
        engine.ingest_files(batch)

    stream = engine.spark.readStream.format("binaryFile").schema(files.FILES).option("maxFilesPerTrigger", files_per_batch).load(landing)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
