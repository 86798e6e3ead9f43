"""Collection jobs as tables: leases, checkpoints, backfills and circuits as expressions over all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.streaming.refresh import after_failure, next_jobs

# States of backfill partitions in the order in which they tell the state of the whole.
BACKFILL_STATES = ("running", "pending", "failed", "paused", "cancelled", "completed")


def claim(jobs: DataFrame, circuits: DataFrame, worker: str, at: Column, lease_seconds: int, most: int = 20) -> DataFrame:
    """The next jobs of sources whose circuit is not open, marked as running with a lease."""
    shut = circuits.filter(F.col("open_until") > at).select("source_id")
    taken = next_jobs(jobs.join(shut, "source_id", "left_anti"), at, most)
    return taken.withColumns({"state": F.lit("running"), "worker_id": F.lit(worker), "attempts": F.col("attempts") + 1, "lease_expires_at": at + F.make_dt_interval(secs=F.lit(lease_seconds))})


def heartbeat(jobs: DataFrame, worker: str, at: Column, lease_seconds: int) -> DataFrame:
    """Longer leases for the running jobs of a worker whose lease has not ended."""
    own = (F.col("state") == "running") & (F.col("worker_id") == worker) & (F.col("lease_expires_at") > at)
    return jobs.withColumn("lease_expires_at", F.when(own, at + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))


def recover_expired(jobs: DataFrame, at: Column) -> DataFrame:
    """Jobs after the running ones whose lease ended went the way of failures."""
    lost = (F.col("state") == "running") & (F.col("lease_expires_at") <= at)
    failed = after_failure(jobs.filter(lost), at).withColumn("lease_expires_at", F.lit(None).cast(jobs.schema["lease_expires_at"].dataType))
    return jobs.filter(~F.coalesce(lost, F.lit(False))).unionByName(failed.select(*jobs.columns))


def expire_pauses(jobs: DataFrame, at: Column) -> DataFrame:
    """Jobs after pauses for a human that lasted too long ended as failed."""
    late = F.coalesce((F.col("state") == "paused") & (F.col("pause_expires_at") <= at), F.lit(False))
    return jobs.withColumns({"state": F.when(late, "failed").otherwise(F.col("state")), "error_code": F.when(late, "human_checkpoint_expired").otherwise(F.col("error_code"))})


def circuit_allows(circuits: DataFrame, at: Column) -> DataFrame:
    """``source_id, allowed, circuit``: closed, open until its time has come, then half open for one try."""
    state = F.when(F.coalesce("failures", F.lit(0)) == 0, "closed").when(F.col("open_until") > at, "open").when(F.col("open_until").isNotNull(), "half_open").otherwise("closed")
    return circuits.select("source_id", (state != "open").alias("allowed"), state.alias("circuit"))


def complete(jobs: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Jobs after those in ``done`` (``job_id``) were closed."""
    d = done.select("job_id").distinct().withColumn("_d", F.lit(True))
    met = jobs.join(d, "job_id", "left")
    ended = F.coalesce("_d", F.lit(False)) & (F.col("state") == "running")
    return met.withColumns({"state": F.when(ended, "completed").otherwise(F.col("state")), "finished_at": F.when(ended, at).otherwise(F.col("finished_at"))}).select(*jobs.columns)


def advance_checkpoints(checkpoints: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Checkpoints of sources after their jobs: one version on, the new position, the newest observation; never back.

    ``done`` has ``source_id, job_id, position, last_observed_at`` of finished or partly finished jobs.
    """
    new = done.groupBy("source_id").agg(F.max_by("position", F.struct("last_observed_at", "job_id")).alias("_p"), F.max("last_observed_at").alias("_o"))
    met = checkpoints.join(new, "source_id", "full_outer")
    moved = F.col("_o").isNotNull()
    on = moved & F.coalesce(F.col("_o") >= F.col("last_observed_at"), F.lit(True))
    return met.select(
        "source_id", (F.coalesce("version", F.lit(0)) + moved.cast("int")).alias("version"), F.when(on, F.col("_p")).otherwise(F.col("position")).alias("position"),
        F.greatest("last_observed_at", "_o").alias("last_observed_at"), F.when(moved, at).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


def partial_progress(batch: DataFrame, failed: DataFrame, part: str = "part_id") -> DataFrame:
    """The rows of the parts of a failed batch that were finished: they are written as any others, again if need be."""
    return batch.join(failed.select(part).distinct(), part, "left_anti").select(*batch.columns)


def dead_letters(jobs: DataFrame, stored: DataFrame, checkpoints: DataFrame, at: Column) -> DataFrame:
    """One dead letter for each dead job that has none yet, with the position of its source."""
    dead = jobs.filter("state = 'dead_letter'").join(stored.select("job_id").distinct(), "job_id", "left_anti")
    return dead.join(checkpoints.select("source_id", "position"), "source_id", "left").select("job_id", "source_id", "attempts", "error_code", "position", at.alias("dead_at"))


def request_backfill(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """New partitions ``source_id, lower, upper`` of a backfill, one for each key that is not stored; empty ones are refused."""
    key = F.sha2(F.concat_ws("\0", "source_id", F.col("lower").cast("string"), F.col("upper").cast("string")), 256)
    fresh = wanted.filter("lower < upper").withColumn("partition_key", key).dropDuplicates(["partition_key"])
    return fresh.join(stored.select("partition_key"), "partition_key", "left_anti").select("source_id", "partition_key", "lower", "upper", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def claim_partitions(partitions: DataFrame, at: Column) -> DataFrame:
    """For each source its next partition: the oldest by ``created_at`` that waits or failed and has attempts left. One that runs bars no other."""
    free = partitions.filter("state in ('pending', 'failed') and attempts < max_attempts")
    first = free.groupBy("source_id").agg(F.min_by("partition_key", F.struct("created_at", "partition_key")).alias("partition_key"))
    return free.join(first, ["source_id", "partition_key"]).select("source_id", "partition_key", "lower", "upper", F.lit("running").alias("state"), (F.col("attempts") + 1).cast("long").alias("attempts"), at.alias("started_at"))


def end_partitions(partitions: DataFrame, results: DataFrame) -> DataFrame:
    """Running partitions after ``results`` (``partition_key, succeeded, retryable``): completed or failed; what can't be retried has no attempt left."""
    told = results.select("partition_key", "succeeded", (F.coalesce("retryable", F.lit(True)) if "retryable" in results.columns else F.lit(True)).alias("_again"))
    met = partitions.join(told, "partition_key", "left")
    ended = (F.col("state") == "running") & F.col("succeeded").isNotNull()
    state = F.when(ended & F.col("succeeded"), "completed").when(ended, "failed").otherwise(F.col("state"))
    spent = F.when(ended & ~F.col("succeeded") & ~F.col("_again"), F.greatest("attempts", "max_attempts")).otherwise(F.col("attempts")).cast(partitions.schema["attempts"].dataType)
    return met.withColumns({"state": state, "attempts": spent}).select(*partitions.columns)


def backfill_health(partitions: DataFrame) -> DataFrame:
    """Per source the state that comes first in the fixed order among its partitions."""
    n = len(BACKFILL_STATES)
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(BACKFILL_STATES) for x in (s, n - i)])[F.col("state")]
    return partitions.groupBy("source_id").agg(F.max_by("state", rank).alias("backfill_state"), F.count("*").alias("partitions"))


def priority_refresh(sources: DataFrame, jobs: DataFrame, at: Column) -> DataFrame:
    """A job at once for each source, named by the minute, so that asking again within it adds none."""
    minute = F.date_trunc("minute", at).cast("timestamp_ntz")
    key = F.sha2(F.concat_ws("\0", F.lit("priority"), F.col("source_id").cast("string"), minute.cast("string")), 256)
    return sources.select("source_id", minute.alias("scheduled_at"), key.alias("job_key")).join(jobs.select("job_key"), "job_key", "left_anti").select("source_id", "scheduled_at", "job_key")
