"""Sessions by their events (session_id, ts, action): begun, used, ended; who is idle, for how long, and who has expired."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.history import GAP
from codeweft.sources.store import delete_session

EVENTS = "session_id string, ts timestamp, action string"


class Registry:
    """The events of all sessions in one folder; a session's tables stand beside them, as :mod:`store` writes them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(os.path.join(self.folder, "sessions"))
        except AnalysisException:
            return self.spark.createDataFrame([], EVENTS)

    def _add(self, session_id: str, action: str, at: datetime | None) -> None:
        row = [(session_id, at or datetime.now(timezone.utc), action)]
        self.spark.createDataFrame(row, EVENTS).write.mode("append").parquet(os.path.join(self.folder, "sessions"))

    def start(self, at: datetime | None = None) -> str:
        session_id = str(uuid.uuid4())
        self._add(session_id, "start", at)
        return session_id

    def touch(self, session_id: str | None, at: datetime | None = None) -> None:
        self.validate(session_id)
        self._add(session_id, "use", at)

    def end(self, session_id: str | None, at: datetime | None = None) -> None:
        """End a session and remove its tables' rows."""
        self.validate(session_id)
        self._add(session_id, "end", at)
        delete_session(self.spark, self.folder, session_id)

    def validate(self, session_id: str | None) -> None:
        """Raise ValueError without an id, KeyError for one that never began or has ended."""
        if not session_id:
            raise ValueError("no session id")
        if live(self.events()).where(F.col("session_id") == session_id).isEmpty():
            raise KeyError(session_id)

    def sweep(self, now: datetime) -> list[str]:
        """End the sessions that have expired, and say which: at most those of one sweep's idle time."""
        gone = [r[0] for r in idle(self.events(), now).where("expired").select("session_id").collect()]
        for session_id in gone:
            self.end(session_id, now)
        return gone


def live(events: DataFrame) -> DataFrame:
    """(session_id, created_at, last_active) of the sessions that began and have not ended."""
    per = events.groupBy("session_id").agg(F.min(F.when(F.col("action") == "start", F.col("ts"))).alias("created_at"), F.max("ts").alias("last_active"), F.bool_or(F.col("action") == "end").alias("ended"))
    return per.where("created_at is not null and not ended").drop("ended")


def idle(events: DataFrame, now: datetime) -> DataFrame:
    """:func:`live` with ``idle_minutes`` at ``now``, and ``expired``: idle for more than GAP."""
    at = F.lit(now).cast("timestamp")
    rows = live(events).withColumn("idle_minutes", F.floor((F.unix_micros(at) - F.unix_micros("last_active")) / 60_000_000))
    return rows.withColumn("expired", F.col("last_active") + F.expr(f"interval {GAP}") < at)
