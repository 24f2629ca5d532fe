"""Incremental collation of a stream of documents (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonority.functions.segments import lexicon


def collate(stream: DataFrame, segments: tuple[str, ...], folder: str, checkpoint: str) -> None:
    """Collate what has arrived into ``folder`` and end.

    Each micro-batch is counted on its own into a subfolder of its number, which a repeated batch writes anew; sums over
    the subfolders are the lexicon. No state grows with the vocabulary.
    """

    def add(batch: DataFrame, number: int) -> None:
        lexicon(batch, segments).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collated(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon ``word, freq`` of all batches so far."""
    return spark.read.parquet(folder).groupBy("word").agg(F.sum("freq").alias("freq"))
