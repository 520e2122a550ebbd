"""Runs from streams of start and finish events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def joined_runs(starts: DataFrame, finishes: DataFrame, late: str = "10 minutes", longest: str = "2 hours") -> DataFrame:
    """(run_id, app_name, started_at, finished_at, status): each start with its finish, at most longest later; on streams a start
    without one comes out as running when the watermark has passed."""
    timed = lambda df, c: df.withWatermark(c, late) if df.isStreaming else df
    s = timed(starts.select("run_id", "app_name", F.col("ts").cast("timestamp").alias("started_at")), "started_at")
    f = timed(finishes.select(F.col("run_id").alias("__run"), "status", F.col("ts").cast("timestamp").alias("finished_at")), "finished_at")
    inside = (F.col("run_id") == F.col("__run")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    return s.join(f, inside, "left_outer").select("run_id", "app_name", "started_at", "finished_at", F.coalesce("status", F.lit("running")).alias("status"))
