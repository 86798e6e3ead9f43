"""A job table that several workers claim from: every change is an optimistic commit, so no job is given out twice.

A claim reads a version of the tables, decides in one plan which jobs it takes, and publishes the changed rows only if that
version is still the newest; otherwise it reads again.
"""

from __future__ import annotations

import random
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.operators.publish import Conflict, Publication, Table

JOB = "job_id long, source_id long, state string, scheduled_for timestamp_ntz, created_at timestamp_ntz, available_at timestamp_ntz, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, error_code string"
CIRCUIT = "source_id long, circuit string, failures int, reopen_at timestamp_ntz, trial_job long"
CHECKPOINT = "source_id long, version long, position string, last_observed_at timestamp_ntz"
OBSERVATION = "observation_id string, source_id long, payload string"
TABLES = {"jobs": Table(JOB, ("job_id",)), "circuits": Table(CIRCUIT, ("source_id",)), "checkpoints": Table(CHECKPOINT, ("source_id",)), "observations": Table(OBSERVATION, ("observation_id",))}
#: Jobs that one claim looks at, as the reference rule has it.
LOOKED_AT = 20


def claimable(jobs: DataFrame, circuits: DataFrame, at: Column, worker: str, lease_seconds: int, most: int = LOOKED_AT) -> tuple[DataFrame, DataFrame]:
    """Changed jobs and changed circuits of a claim of one job.

    Of the ``most`` oldest jobs that are due: those of an open circuit wait until it reopens; those without an attempt left
    become dead letters; the first that is left runs. A circuit whose time has come is half open and lets one trial job
    through until that job has ended.
    """
    due = jobs.filter(F.col("state").isin("pending", "retry_scheduled") & (F.col("available_at") <= at)).orderBy("scheduled_for", "created_at", "job_id").limit(most)
    met = due.join(circuits.select("source_id", "circuit", "reopen_at", "trial_job"), "source_id", "left")
    shut = F.coalesce(F.col("circuit") != "closed", F.lit(False))
    waits, tried = shut & F.coalesce(F.col("reopen_at") > at, F.lit(False)), shut & F.col("trial_job").isNotNull()
    used_up = F.col("attempt") >= F.col("max_attempts")
    fate = F.when(waits, "wait").when(tried, "bar").when(used_up, "dead").otherwise("free")
    # at most LOOKED_AT rows, by the limit above
    everyone, oldest = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("scheduled_for", "created_at", "job_id")
    placed = met.withColumn("fate", fate).withColumn("place", F.row_number().over(oldest))
    placed = placed.withColumn("first", F.min(F.when(F.col("fate") == "free", F.col("place"))).over(everyone))
    seen = placed.filter(F.col("first").isNull() | (F.col("place") <= F.col("first"))).withColumn("fate", F.when(F.col("place") == F.col("first"), "run").otherwise(F.col("fate")))
    run, dead, wait = (F.col("fate") == f for f in ("run", "dead", "wait"))
    changed = seen.filter(run | dead | wait).select(
        "job_id", "source_id", F.when(run, "running").when(dead, "dead_letter").otherwise(F.col("state")).alias("state"), "scheduled_for", "created_at",
        F.when(wait, F.greatest("available_at", "reopen_at")).otherwise(F.col("available_at")).alias("available_at"), (F.col("attempt") + run.cast("int")).alias("attempt"), "max_attempts",
        F.when(run, F.lit(worker)).alias("lease_owner"), F.when(run, at + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("lease_expires_at"), F.when(dead, "attempt_limit_reached").when(wait, F.col("error_code")).alias("error_code"),
    )
    trials = seen.filter(run & shut).select("source_id", F.col("job_id").alias("trial"))
    opened = circuits.join(trials, "source_id").select("source_id", F.lit("half_open").alias("circuit"), "failures", "reopen_at", F.col("trial").alias("trial_job"))
    return changed, opened


class Queue:
    """Jobs, circuits, checkpoints and observations below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.tables = spark, Publication(spark, root, TABLES)

    def _commit(self, make, tries: int = 50):
        """Publish what ``make(manifest)`` gives (parts and an answer), again from the newest version after a conflict."""
        for _ in range(tries):
            base = self.tables.manifest()
            parts, answer = make(base)
            if not parts:
                return answer
            try:
                self.tables.publish(uuid.uuid4().hex, parts, read=base["version"])
                return answer
            except Conflict:
                time.sleep(random.random() * 0.2)
        raise Conflict(f"{tries} tries came too late")

    def add(self, jobs: DataFrame) -> None:
        self.tables.publish(uuid.uuid4().hex, [("jobs", jobs)])

    def claim(self, worker: str, at: Column, lease_seconds: int = 300) -> int | None:
        """The job that ``worker`` may run now, or None; no other worker gets it."""

        def make(base):
            jobs, circuits = (self.tables.read(n, manifest=base) for n in ("jobs", "circuits"))
            changed, opened = claimable(jobs, circuits, at, worker, lease_seconds)
            rows, trials = changed.collect(), opened.collect()  # of at most LOOKED_AT jobs
            won = next((r.job_id for r in rows if r.state == "running"), None)
            parts = [("jobs", self.spark.createDataFrame(rows, changed.schema))] if rows else []
            return parts + ([("circuits", self.spark.createDataFrame(trials, opened.schema))] if trials else []), won

        return self._commit(make)

    def complete(self, job_id: int, worker: str, at: Column, observations: DataFrame, position: str, observed_at: Column) -> bool:
        """Close a job that ``worker`` still holds: observations, checkpoint, job and circuit in one publication."""

        def make(base):
            jobs = self.tables.read("jobs", self.spark.createDataFrame([(job_id,)], "job_id long"), manifest=base)
            held = jobs.filter((F.col("state") == "running") & (F.col("lease_owner") == worker) & (F.col("lease_expires_at") > at))
            found = held.select("source_id").collect()
            if not found:
                return [], False
            source = self.spark.createDataFrame([(found[0].source_id,)], "source_id long")
            known = source.join(self.tables.read("checkpoints", source, manifest=base), "source_id", "left")
            newer = F.coalesce(observed_at >= F.col("last_observed_at"), F.lit(True))
            checkpoint = known.select("source_id", (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), F.when(newer, F.lit(position)).otherwise(F.col("position")).alias("position"), F.greatest("last_observed_at", observed_at).alias("last_observed_at"))
            done = held.withColumns({"state": F.lit("completed"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.lit(None).cast("string")})
            closed = source.select("source_id", F.lit("closed").alias("circuit"), F.lit(0).alias("failures"), F.lit(None).cast("timestamp_ntz").alias("reopen_at"), F.lit(None).cast("long").alias("trial_job"))
            return [("observations", observations), ("checkpoints", checkpoint), ("jobs", done), ("circuits", closed)], True

        return self._commit(make)

    def fail(self, job_id: int, worker: str, at: Column, error_code: str, retryable: bool = True, threshold: int = 3, reset_seconds: int = 900, base_seconds: int = 30, most_seconds: int = 900) -> bool:
        """A failed attempt: retried after a doubled delay, or a dead letter; its circuit opens at the threshold, or at once after a trial."""

        def make(base):
            jobs = self.tables.read("jobs", self.spark.createDataFrame([(job_id,)], "job_id long"), manifest=base)
            held = jobs.filter((F.col("state") == "running") & (F.col("lease_owner") == worker))
            found = held.select("source_id").collect()
            if not found:
                return [], False
            again = F.lit(retryable) & (F.col("attempt") < F.col("max_attempts"))
            delay = F.least(F.lit(float(base_seconds)) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(float(most_seconds)))
            failed = held.withColumns({
                "state": F.when(again, "retry_scheduled").otherwise("dead_letter"), "available_at": F.when(again, at + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).otherwise(F.col("available_at")),
                "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.lit(error_code),
            })
            source = self.spark.createDataFrame([(found[0].source_id,)], "source_id long")
            known = source.join(self.tables.read("circuits", source, manifest=base), "source_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)) + 1)
            trips = (F.col("failures") >= threshold) | F.coalesce(F.col("circuit") == "half_open", F.lit(False))
            circuit = known.select("source_id", F.when(trips, "open").otherwise("closed").alias("circuit"), F.col("failures").cast("int").alias("failures"), F.when(trips, at + F.make_dt_interval(secs=F.lit(reset_seconds))).alias("reopen_at"), F.lit(None).cast("long").alias("trial_job"))
            return [("jobs", failed), ("circuits", circuit)], True

        return self._commit(make)
