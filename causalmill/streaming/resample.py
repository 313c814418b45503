"""The bucket aggregation of ``resample`` on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import checkpoint_dir

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def resample_stream(
    events: DataFrame, ts: str, width: str = "1 day", method: str = "mean", columns: Sequence[str] = (), by: Sequence[str] = (), late: str = "1 hour"
) -> DataFrame:
    """Time buckets of a streaming (or batch) table; rows later than ``late`` are dropped by the watermark.

    A bucket is final once the watermark has passed its end. State holds the open buckets only.
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", width), *by).agg(*[AGGREGATES[method](c).alias(c) for c in columns], F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("window.start").alias("bucket"), *by, *columns, "rows")


def write_buckets(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append final buckets as parquet files; progress is kept beside the checkpoints of the cluster."""
    root = checkpoint_dir(stream.sparkSession)
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", f"{root}/stream-{name}").trigger(availableNow=True).start()
    )
