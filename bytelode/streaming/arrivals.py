"""Recovery of files as they arrive: each micro-batch is one batch plan, duplicates across batches go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import salvage


def carve_arrivals(blobs: DataFrame, output: str, checkpoint: str, key: str = "blob_id", remembered: str = "30 days") -> StreamingQuery:
    """Appends the files recovered from arriving blobs to Parquet; a blob's bytes are recovered once.

    Digests are remembered for as long as `remembered` by the blobs' modificationTime, so the
    state does not grow for ever; bytes that come again later are recovered again.
    """
    digested = blobs.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", remembered)
    once = digested.dropDuplicatesWithinWatermark(["digest"]).drop("digest")

    def run(batch: DataFrame, number: int) -> None:
        files, _ = salvage.recover(batch.select(key, "content"), key)
        files.write.mode("overwrite").parquet(f"{output}/batch={number}")  # a batch that is run again replaces its own output

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
