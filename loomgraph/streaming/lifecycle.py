"""Lifecycle events as a stream: an extra, beyond the batch engine. Each trigger folds new events into the latest state of each generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def state_stream(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """events (streaming): ts, repo_id, worktree_id, generation_id, action. Of each window and generation its last action and number of events."""
    key = ["repo_id", "worktree_id", "generation_id"]
    timed = events.withWatermark("ts", delay).groupBy(F.window("ts", window), *key)
    return timed.agg(F.max_by("action", "ts").alias("last_action"), F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("since"), *key, "last_action", "events")
