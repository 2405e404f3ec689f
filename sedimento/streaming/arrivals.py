"""The catalog as a stream: late rows, running counts, suggestions for arriving samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimento.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def deduplicated(stream: DataFrame, key: str = "id", at: str = "created_at", late: str = "7 days") -> DataFrame:
    """Rows without those delivered again within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def growth(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows by window of created_at and modality, final once the watermark has passed."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", window), "modality").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "modality", "n")


def suggest_on_arrival(stream: DataFrame, out: str, suggest: Callable[[DataFrame], DataFrame], name: str, once: bool = True) -> StreamingQuery:
    """Batch operators over each micro-batch; a batch is written to its own folder, so a retry overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        suggest(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint_dir(stream.sparkSession)}/{name}")
    return (w.trigger(availableNow=True) if once else w).start()
