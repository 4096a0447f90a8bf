"""An extension: images that arrive as a stream, searched and stored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from huespan.operators import search
from huespan.sources.images import SCHEMA


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """Images of Parquet files as they come into a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def hits_stream(images: DataFrame, query: search.Point, threshold: float) -> DataFrame:
    """Hits of a standing query; a filter only, so it holds no state."""
    return search.hits(images, query, threshold, "bbox")


def store_stream(images: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every batch to the stored images, each in a folder of its own (batch=N), which a batch that is run again replaces."""

    def store(batch: DataFrame, number: int) -> None:
        batch.select(*SCHEMA.names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return images.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
