"""Uploads as a stream: new files are validated and marked batch by batch; failures go to a quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SUBMISSION


def mark_uploads(spark: SparkSession, path: str, out: str, quarantine: str, checkpoint: str, mark: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a query over JSON-lines files below ``path``; each batch's good lines go through ``mark`` to ``out``.

    Batches are written under their own number, so a batch that runs again after a failure replaces itself.
    """
    raw = spark.readStream.format("text").load(path).select("value", F.col("_metadata.file_name").alias("source_filename"))

    def each(batch: DataFrame, number: int) -> None:
        parsed = batch.withColumn("doc", F.from_json("value", SUBMISSION))
        good = F.coalesce(F.size("doc.sub_parts") >= 1, F.lit(False))
        mark(parsed.filter(good).select("doc.*", "source_filename")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        parsed.filter(~good).select("value", "source_filename").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
