"""Tiling runs that pick up where they stopped: new tile files are processed once, also after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_tiles(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]
):
    """Run ``transform`` over tile files that arrived since the last run, append to ``sink``, and stop.

    The checkpoint folder (on shared storage) remembers finished files, which replaces a resume offset.
    ``transform`` must be row-wise: filters, tile kernels, scoring.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
