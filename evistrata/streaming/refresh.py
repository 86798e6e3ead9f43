"""Structured Streaming: counts per window and stateful source health, and the schedule of jobs as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts_per_window(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Events per key and tumbling window of event time; what comes later than ``late`` is left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def circuits(outcomes: DataFrame, threshold: int = 3, reset_seconds: int = 900) -> DataFrame:
    """State of each source after every batch: consecutive failures, and until when its circuit is open.

    ``outcomes`` has ``source_id, at, failed``. The state is a counter and a time, whatever the number
    of events.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0)
        rows = pd.concat(batches).sort_values("at")
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            failures = failures + 1 if failed else 0
            if failures and failures % threshold == 0:
                until = int(at.timestamp()) + reset_seconds
        state.update((int(failures), int(until)))
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "open_until": [until]})

    return outcomes.groupBy("source_id").applyInPandasWithState(step, "source_id long, failures long, open_until long", "failures long, until long", "update", GroupStateTimeout.NoTimeout)


def due_jobs(sources: DataFrame, active: DataFrame, at, seconds: str = "interval_seconds") -> DataFrame:
    """One job per source and schedule slot, unless one is active for the source."""
    now = F.unix_seconds(at.cast("timestamp"))
    slot = F.timestamp_seconds(now - F.pmod(now, F.col(seconds))).cast("timestamp_ntz")
    return sources.join(active.select("source_id").distinct(), "source_id", "left_anti").withColumn("slot", slot).withColumn("job_key", F.sha2(F.concat_ws("\0", "source_id", F.col("slot").cast("string")), 256))


def next_jobs(jobs: DataFrame, at, most: int = 20) -> DataFrame:
    """The jobs to run next: due, attempts left, oldest schedule first; a top-k."""
    return jobs.filter((F.col("scheduled_at") <= at) & (F.col("attempts") < F.col("max_attempts")) & F.col("state").isin("pending", "failed")).orderBy("scheduled_at", "created_at", "job_id").limit(most)


def after_failure(jobs: DataFrame, at, base: int = 30, most: int = 900) -> DataFrame:
    """Failed jobs with their next state: retry after a doubled delay, or dead letter."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(float(most)))
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumn("state", F.when(again, "pending").otherwise("dead_letter")).withColumn("scheduled_at", F.when(again, at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay.cast("decimal(18,6)"))).otherwise(F.col("scheduled_at")))


def last_outcomes(history: DataFrame, n: int) -> DataFrame:
    """The last ``n`` outcomes of each source."""
    w = Window.partitionBy("source_id").orderBy(F.col("at").desc())
    return history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
