"""What a batch of signals changes: hypotheses, opportunities and components of the touched organizations, and of no other.

Organizations, evidence and signals are merged, then the touched keys travel on: the stored signals of just those organizations
are read (by their buckets), fused and scored again, and everything is published at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.operators import fusion, sinks
from evistrata.operators.lineage import written
from evistrata.operators.publish import Publication, Table

SIGNAL = (
    "signal_id long, organization_id long, evidence_id string, corroboration_key string, effective_at timestamp_ntz, expires_at timestamp_ntz, confidence double, polarity string, signal_type string, is_explicit boolean, "
    "historical_only boolean, hypothesis_classes array<string>, service_families array<string>, title string, summary string, matched_terms array<string>"
)
TABLES = {
    "organizations": Table("organization_id long, name string, registration_ids array<string>, updated_at timestamp_ntz", ("organization_id",)),
    "evidence": Table("evidence_id string, organization_id long, collected_at timestamp_ntz", ("evidence_id", "organization_id"), "organization_id"),
    "signals": Table(SIGNAL, ("signal_id", "organization_id"), "organization_id"),
    "hypotheses": Table("organization_id long, requested_class string, family string, hypothesis_class string, confidence double, urgency string, horizon string, expires_at timestamp_ntz, independent long, supporting long, signals long", ("organization_id", "requested_class", "family")),
    "opportunities": Table("organization_id long, state string, snoozed_until timestamp_ntz, score double, raw_score double, confidence double, tenders long, jobs long, last_evidence_at timestamp_ntz, data_quality string, expires_at timestamp_ntz", ("organization_id",)),
    "components": Table("organization_id long, rule string, value double, weight double, overridden boolean, original_value double, original_weight double", ("organization_id", "rule")),
}


def store(spark: SparkSession, root: str) -> Publication:
    return Publication(spark, root, TABLES)


def _gone(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """``now`` with a tombstone for each stored key that it lacks."""
    left = stored.join(now.select(*keys), keys, "left_anti").withColumn("deleted", F.lit(True))
    return now.withColumn("deleted", F.lit(False)).unionByName(left, allowMissingColumns=True)


def persist(kept: Publication, batch: str, organizations: DataFrame, evidence: DataFrame, signals: DataFrame, as_of: Column) -> int:
    """Publish a batch with all that follows from it; the version that holds it.

    ``organizations``, ``evidence`` and ``signals`` have the columns of ``TABLES`` (evidence and signals once for each key; those of an id
    that is stored replace it). Organizations of the batch, and those that its signals name, are scored again from all their signals. An
    opportunity that no longer follows stays as it was with the analyst; hypotheses that no longer follow go; components that an analyst
    overrode keep the analyst's value. Signals without an organization are refused (they have no place). A batch that is published
    already changes nothing.
    """
    base = kept.manifest()
    if batch in base["batches"]:
        return base["version"]
    signals = written(signals.filter("organization_id is not null"), "signals")
    touched = written(organizations.select("organization_id").unionByName(signals.select("organization_id")).filter("organization_id is not null").distinct(), "touched")
    stored = lambda name: kept.read(name, touched, base)

    merged = sinks.merge_organizations(stored("organizations"), organizations.dropDuplicates(["organization_id"]))
    known = stored("signals").join(signals, ["signal_id", "organization_id"], "left_anti").select(*signals.columns).unionByName(signals)
    known = written(known, "known-signals")

    hypotheses = fusion.fuse(known, as_of)
    columns = [f.name for f in kept._schema("hypotheses") if f.name != "deleted"]
    hypotheses = _gone(stored("hypotheses"), hypotheses.select(*columns), list(TABLES["hypotheses"].keys))

    scored = written(fusion.buying_intent(known, as_of), "scored")
    fresh = scored.select(F.col("organization_id").alias("hypothesis_id"), F.lit("needs_review").alias("state"), F.lit(None).cast("timestamp_ntz").alias("snoozed_until"), "score", "raw_score", "confidence", "tenders", "jobs", "last_evidence_at", "data_quality", "expires_at")
    had = stored("opportunities").withColumnRenamed("organization_id", "hypothesis_id").select(*fresh.columns)
    opportunities = sinks.upsert_opportunities(had, fresh, as_of).withColumnRenamed("hypothesis_id", "organization_id")

    generated = scored.select(F.col("organization_id").alias("opportunity_id"), F.inline("components")).select("opportunity_id", "rule", "value", "weight")
    old = stored("components").withColumnRenamed("organization_id", "opportunity_id").join(scored.select(F.col("organization_id").alias("opportunity_id")), "opportunity_id", "left_semi")
    components = _gone(old, sinks.sync_components(old, generated), ["opportunity_id", "rule"]).withColumnRenamed("opportunity_id", "organization_id")
    return kept.publish(batch, [("organizations", merged), ("evidence", evidence), ("signals", signals), ("hypotheses", hypotheses), ("opportunities", opportunities), ("components", components)], read=base["version"])
