"""Manifest rows as a stream: each new key once, each new body extracted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.url import canon_key
from ..sources.artifacts import MANIFEST


def manifest_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files).json(path)


def new_keys(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows whose canonical key hasn't come within `late`; state is kept that long."""
    rows = rows.withColumn("canon_key", F.coalesce("canon_key", canon_key(F.col("url")))).withColumn("at", F.to_timestamp("fetched_at"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["canon_key"])


def ingest(rows: DataFrame, out: str, checkpoints: str, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Appends what `then` makes of each batch to Parquet files, a batch's folder being replaced if it comes again."""

    def write(batch: DataFrame, n: int) -> None:
        then(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
