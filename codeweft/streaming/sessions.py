"""Session expiry on a stream of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.history import GAP


def live_sessions(activity: DataFrame, user: str, at: str, late: str = "30 minutes") -> DataFrame:
    """(user, start, end, events) of sessions that ended: idle for GAP; activity later than ``late`` is left out.

    State is one row for each open session and leaves with the watermark.
    """
    w = F.session_window(F.col(at), GAP)
    out = activity.withWatermark(at, late).groupBy(F.col(user).alias("user"), w.alias("w")).agg(F.count("*").alias("events"))
    return out.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def replace_sessions(stream: DataFrame, path: str, checkpoint: str, every: str = "30 minutes") -> StreamingQuery:
    """Each micro-batch replaces the stored rows of the sessions it holds; a batch that runs again writes the same."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.option("partitionOverwriteMode", "dynamic").partitionBy("session_id").mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
