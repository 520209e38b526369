"""Pages as a stream: complete page documents arrive as files, each snapshot is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.readers import SNAPSHOT


def snapshot_stream(spark: SparkSession, path: str, files_per_batch: int = 100, remember: str = "7 days") -> DataFrame:
    """Snapshot documents as they appear in a folder; a snapshot_id that comes again within the remembered time is passed over.

    Time is that of the files, so the state holds the ids of that long and no more, however long the stream runs.
    """
    docs = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files_per_batch).json(path)
    docs = docs.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))
    return docs.withWatermark("arrived_at", remember).dropDuplicatesWithinWatermark(["snapshot_id"]).drop("arrived_at")


def process(stream: DataFrame, run: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of complete pages through run(), appended by batch; a batch that is repeated after a failure replaces its own output."""

    def batch(docs: DataFrame, number: int) -> None:
        rows = docs.select("page_id", "snapshot_id", F.explode("evidence").alias("e")).select("page_id", "snapshot_id", "e.*")
        run(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
