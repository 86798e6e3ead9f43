"""Professional context: persons, roles, reporting lines and communities at a time, within retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.operators.graph import is_current
from evistrata.operators.reconcile import some
from evistrata.operators.revisions import RevisionSpec, effective

CLAIMS = RevisionSpec(supersedes="supersedes_record_key", from_all=True, fallback="event_key")


def person_key(source: Column, record: Column) -> Column:
    return F.concat(F.lit("professional-person:"), F.sha2(F.concat_ws("\x1f", source, record), 256))


def permitted(now: Column) -> Column:
    """Whether a statement may still be processed: its retention has not ended."""
    return F.coalesce(F.col("retention_until") > now, F.lit(True))


def reconcile_persons(references: DataFrame, now: Column) -> DataFrame:
    """Persons as their newest reference tells them; shown while that is visible, not suppressed, not deleted, and may be kept."""
    newest = F.max_by(F.struct("display_name", "source_id", "confidence", "suppressed", "deleted", "retention_until"), F.struct("observed_at", "snapshot_id"))
    found = references.groupBy("person_key").agg(newest.alias("n"), F.max("observed_at").alias("last_observed_at"), F.count("*").alias("references"))
    found = found.select("person_key", "n.*", "last_observed_at", "references")
    return found.withColumn("current", ~F.col("suppressed") & ~F.col("deleted") & permitted(now))


def reconcile_reporting(claims: DataFrame, now: Column) -> DataFrame:
    """Reporting lines: the newest live claim is the basis, else the newest of all; ``current`` while any is live."""
    rows = effective(claims, CLAIMS)
    live = F.col("active") & is_current(now) & permitted(now)
    shown, order = F.struct("subject_key", "manager_key", "organization_id"), F.struct("modified_at", "snapshot_id")
    found = rows.groupBy("event_key").agg(
        F.max_by(F.when(live, shown), F.when(live, order)).alias("l"), F.max_by(shown, order).alias("a"), some(live).alias("current"), F.max(F.when(live, F.col("confidence"))).alias("lc"), F.max("confidence").alias("ac"),
        F.max("retention_until").alias("retention_until"), F.count("*").alias("evidence"),
    )
    basis = F.coalesce("l", "a")
    return found.select("event_key", basis["subject_key"].alias("subject_key"), basis["manager_key"].alias("manager_key"), basis["organization_id"].alias("organization_id"), "current", F.coalesce("lc", "ac").alias("confidence"), "retention_until", "evidence")


def reconcile_communities(contexts: DataFrame, now: Column) -> DataFrame:
    """Communities: as reporting lines, with a conflict if live statements give several pairs of type and value."""
    rows = effective(contexts, CLAIMS)
    live = F.col("active") & is_current(now) & permitted(now)
    shown, order = F.struct("context_type", "context_value"), F.struct("modified_at", "snapshot_id")
    found = rows.groupBy("event_key").agg(
        F.max_by(F.when(live, shown), F.when(live, order)).alias("l"), F.max_by(shown, order).alias("a"), F.count_distinct(F.when(live, F.struct(F.col("context_type"), F.lower("context_value").alias("v")))).alias("n"), some(live).alias("current"), F.count("*").alias("evidence"),
    )
    basis = F.coalesce("l", "a")
    return found.select("event_key", basis["context_type"].alias("context_type"), basis["context_value"].alias("context_value"), (F.col("n") > 1).alias("has_conflict"), "current", "evidence")


def suppressions(requests: DataFrame, key: bytes, now: Column, least_days: int) -> DataFrame:
    """Entries that keep erased identifiers from coming back: a keyed hash per channel and identifier, kept at least so long."""
    from evistrata.functions.identifiers import contact, hmac_sha256

    hashed = hmac_sha256(key, F.concat_ws(":", "channel", contact(F.col("channel"), F.col("identifier"))))
    return requests.select(hashed.alias("identifier_hash"), "channel", "reason", now.alias("created_at"), (now + F.make_dt_interval(F.greatest(F.col("retention_days"), F.lit(least_days)))).alias("kept_until"))
