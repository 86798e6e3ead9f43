"""Registered queries that run batch by batch; each must give what one query over everything gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import commercial, components, reconcile
from evistrata.operators.lineage import shared_path
from evistrata.operators.revisions import RevisionSpec
from evistrata.plans import decisions, evidence
from evistrata.plans.bindings import VIEWS, for_spark, sql, table, view
from evistrata.sources import collection
from evistrata.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def as_stream(spark, sf_dir, name, table="events"):
    """A view over one table, read as a stream of its files."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern, as a single file is no folder
    return spark.sql(for_spark(VIEWS[name]), **{table: rows})


def stream_changes(spark, sf_dir):
    """Change events kept in step by keyed state."""
    family = state.Family("event_key", lambda rows, at: reconcile.reconcile_changes(rows, evidence.as_of()), RevisionSpec(supersedes="supersedes_record_key"), expires=("expires_at",))
    path = shared_path(spark, "stream-changes")
    state.follow(as_stream(spark, sf_dir, "v_change"), family, path, f"{path}/state").awaitTermination()
    return state.current(spark, path, "event_key").select("event_key", "event_type", "status", "claim_count", "independent_source_count", "has_dispute", "historical_only")


def stream_assets(spark, sf_dir):
    """Assets kept in step by keyed state; counts of the whole history are carried beside the statements that count."""
    spec = RevisionSpec(supersedes="supersedes_record_key", ignore_self=True)
    family = state.Family("asset_key", lambda rows, at: reconcile.reconcile_assets(rows, evidence.as_of(), spec), spec, carried={"history_count": ("count", ""), "first_seen_at": ("min", "published_at")})
    path = shared_path(spark, "stream-assets")
    state.follow(as_stream(spark, sf_dir, "v_change"), family, path, f"{path}/state").awaitTermination()
    return state.current(spark, path, "asset_key").select("asset_key", "history_count", "effective_count", "active_count", "first_seen_at", "last_updated_at", "organization_link_status")


def persist_commercial(spark, sf_dir):
    """Opportunities after two batches of signals, each of which scores the organizations that it touches."""
    kept = commercial.store(spark, shared_path(spark, "commercial"))
    signals = view(spark, sf_dir, "v_signal")
    for half in (1, 0):  # both halves of the table, one batch after the other
        part = signals.filter(F.col("signal_id") % 2 == half)
        organizations = part.select("organization_id").distinct().select("organization_id", F.concat(F.lit("org "), F.col("organization_id")).alias("name"), F.lit(None).cast("array<string>").alias("registration_ids"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
        evidence_rows = part.groupBy("evidence_id", "organization_id").agg(F.max("effective_at").alias("collected_at"))
        commercial.persist(kept, f"half {half}", organizations, evidence_rows, part, evidence.as_of())
    parts = kept.read("components").groupBy("organization_id").agg(F.count("*").alias("components"))
    found = kept.read("opportunities").join(parts, "organization_id")
    return found.select("organization_id", "state", "tenders", "jobs", "last_evidence_at", F.round("score", 6).alias("score"), "data_quality", "components")


def persist_hypotheses(spark, sf_dir):
    """Hypotheses after the same signals in one batch."""
    kept = commercial.store(spark, shared_path(spark, "commercial"))
    signals = view(spark, sf_dir, "v_signal")
    none = spark.createDataFrame([], kept._schema("organizations"))
    commercial.persist(kept, "all", none.drop("deleted"), signals.groupBy("evidence_id", "organization_id").agg(F.max("effective_at").alias("collected_at")), signals, evidence.as_of())
    return kept.read("hypotheses").select("organization_id", "requested_class", "family", "hypothesis_class", F.round("confidence", 9).alias("confidence"), "independent", "supporting", "signals", "expires_at")


def growing_components(spark, sf_dir):
    """Components of all edges, added in two batches to stored labels."""
    kept = components.store(spark, shared_path(spark, "components"))
    edges = view(spark, sf_dir, "v_edge")
    for half in (1, 0):
        components.grow(kept, f"half {half}", edges.filter(F.pmod(F.xxhash64("a"), F.lit(2)) == half))
    return kept.read("labels").select("node", "component")


def collected_parts(spark, sf_dir):
    """Parts written as CSV files, collected by a stream and stored."""
    folder = shared_path(spark, "collected")
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").write.option("header", True).csv(f"{folder}/in")
    spark.dataSource.register(collection.Collected)
    stream = spark.readStream.format("collected").option("path", f"{folder}/in").option("log", f"{folder}/log").option("required", "p_partkey,p_brand,p_size").load()
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return found.select(F.col("record")["p_partkey"].cast("long").alias("p_partkey"), F.col("record")["p_brand"].alias("p_brand"), F.col("record")["p_size"].cast("int").alias("p_size"))


_REGISTERED = (
    (growing_components, decisions.ORACLE_SQL["connected_components"]), (collected_parts, "SELECT p_partkey, p_brand, p_size FROM part"),
    (stream_changes, sql(evidence.CHANGE_ROWS)), (stream_assets, evidence.ORACLE_SQL["reconcile_assets"]), (persist_hypotheses, decisions.ORACLE_SQL["fuse_hypotheses"]),
    (persist_commercial, sql(decisions.MATCHED + """ SELECT organization_id, 'needs_review' AS state, tenders, jobs, last_evidence_at, round(greatest(0.0::double, least(100.0::double, a * 45 + b * 25 + c * 15 + d * 10 + confidence * 5 - f * 20)), 6) AS score,
        CASE WHEN tenders > 0 AND jobs > 0 AND evidence >= 2 THEN 'complete' ELSE 'partial' END AS data_quality, 6 AS components FROM v""")),
)
for _query, _sql in _REGISTERED:
    QUERIES[_query.__name__] = _query
    ORACLE_SQL[_query.__name__] = _sql
