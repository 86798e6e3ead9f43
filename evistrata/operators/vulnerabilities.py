"""Vulnerabilities from the snapshots of several catalogues: one entity for every set of connected identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.operators import components as groups
from evistrata.operators.publish import Publication
from evistrata.operators.reconcile import priority
from evistrata.operators.revisions import RevisionSpec, latest_by

# The strength of the states of a vulnerability.
STATES = {"rejected": 5, "withdrawn": 4, "superseded": 3, "updated": 2, "published": 1}
SNAPSHOTS = RevisionSpec(keys=("source", "source_record_key"))


def vulnerability_id(value: Column) -> Column:
    """Upper-case identifier without surrounding space; null if it has other than letters, digits, dots, colons, dashes and underscores."""
    v = F.upper(F.trim(value))
    return F.when(v.rlike("^[A-Z0-9][A-Z0-9._:-]{1,199}$"), v)


def grouped(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with ``component``: equal for all that share identifiers, directly or through others.

    Snapshots and identifiers are the two sides of a graph, so an identifier that very many snapshots
    carry is one node and never a set of pairs.
    """
    ids = F.array_distinct(F.array_compact(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_id")), vulnerability_id)))
    edges = snapshots.select(F.concat(F.lit("s"), F.col("snapshot_id").cast("string")).alias("a"), F.explode(ids).alias("i")).select("a", F.concat(F.lit("i"), "i").alias("b"))
    found = groups.connected(edges).filter("node like 's%'").select(F.substring("node", 2, 1_000_000).alias("_key"), "component")
    keyed = snapshots.withColumns({"identifiers": ids, "_key": F.col("snapshot_id").cast("string")})
    return keyed.join(found, "_key").drop("_key")


def reconcile(rows: DataFrame) -> DataFrame:
    """One row per component of ``grouped`` snapshots.

    Texts come from the most trusted source (least ``source_precedence``, then the newest) that has any;
    the strongest state stands; the smallest CVE identifier names the vulnerability.
    """
    order = F.struct("source_precedence", -F.unix_micros(F.col("modified_at").cast("timestamp")), "snapshot_id")
    said = lambda c: F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", order)).alias(c)
    found = rows.groupBy("component").agg(
        F.flatten(F.collect_set("identifiers")).alias("ids"), said("title"), said("description"), F.max_by("status", priority("status", STATES)).alias("status"), F.min("published_at").alias("published_at"),
        F.max("modified_at").alias("modified_at"), F.count_distinct("source").alias("source_count"), F.min_by("superseded_by", order).alias("superseded_by"), F.flatten(F.collect_set("cwes")).alias("cwes"),
    )
    cves = F.filter("ids", lambda x: x.like("CVE-%"))
    named = found.withColumn("canonical_id", F.coalesce(F.array_min(cves), F.array_min("ids")))
    return named.select(
        "component", "canonical_id", F.array_sort(F.array_remove(F.array_distinct("ids"), F.col("canonical_id"))).alias("aliases"), "title", "description", "status", "published_at", "modified_at", "source_count",
        F.array_sort(F.array_distinct(F.transform("cwes", F.upper))).alias("cwes"), "superseded_by",
    )


def scores(rows: DataFrame) -> DataFrame:
    """Distinct scores of each component."""
    return rows.select("component", F.inline("scores")).distinct()


def ranges(rows: DataFrame) -> DataFrame:
    """Affected ranges of each component, distinct without regard to the case of ecosystem and product; the last statement is shown."""
    each = rows.select("component", "snapshot_id", F.posexplode("ranges").alias("pos", "r")).select("component", "snapshot_id", "pos", "r.*")
    key = [F.lower("ecosystem").alias("_e"), F.lower("product").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("introduced", "fixed", "last_affected", "precision")]]
    shown = F.max_by(F.struct("ecosystem", "product", "introduced", "fixed", "last_affected", "precision"), F.struct("snapshot_id", "pos")).alias("r")
    return each.groupBy("component", *key).agg(shown).select("component", "r.*")


def exploitation(rows: DataFrame) -> DataFrame:
    """Exploitation of each component by kind: active if any statement is, the widest times, the highest confidence."""
    each = rows.select("component", F.inline("exploitation"))
    return each.groupBy("component", "kind").agg(F.bool_or("active").alias("active"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.min("due_date").alias("due_date"), F.max("confidence").alias("confidence"))


def summaries(rows: DataFrame) -> DataFrame:
    """One row per component with the highest CVSS value, the newest EPSS value and the kinds of active exploitation."""
    each = rows.select("component", "modified_at", F.inline("scores"))
    late = F.coalesce("assessed_at", "modified_at")
    epss = F.col("system") == "epss"
    scored = each.groupBy("component").agg(F.max(F.when(F.col("system").startswith("cvss_"), F.col("value"))).alias("maximum_cvss"), F.max_by(F.when(epss, F.col("value")), F.when(epss, F.struct(late, "value"))).alias("latest_epss"))
    active = rows.select("component", F.inline("exploitation")).filter("active").groupBy("component").agg(F.array_sort(F.collect_set("kind")).alias("exploitation_kinds"))
    none = F.array().cast("array<string>")
    return reconcile(rows).join(scored, "component", "left").join(active, "component", "left").withColumn("exploitation_kinds", F.coalesce("exploitation_kinds", none))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each record of each catalogue."""
    return latest_by(snapshots, SNAPSHOTS)


def by_identifier(found: DataFrame, identifier: str) -> DataFrame:
    """The vulnerability that has ``identifier`` as its name or alias."""
    i = vulnerability_id(F.lit(identifier))
    return found.filter((F.col("canonical_id") == i) | F.array_contains("aliases", i))


def persist(kept: Publication, batch: str, snapshots: DataFrame) -> DataFrame:
    """Add a batch of snapshots to the stored groups of identifiers; gives the stored groups that it joins (``component, merged_into``).

    Those are alias conflicts: entities that were stored apart and turn out to be one. Identifiers that can't be read are left out; each
    snapshot ties its identifiers to its first, so one with a single identifier is a group of its own.
    """
    ids = F.array_distinct(F.array_compact(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_id")), vulnerability_id)))
    tied = snapshots.select(F.array_min(ids).alias("a"), F.explode(ids).alias("b"))
    return groups.grow(kept, batch, tied)


def alias_sets(kept: Publication, only: DataFrame | None = None) -> DataFrame:
    """``component, canonical_id, aliases`` of the stored groups; with ``only`` (``component``) of those groups alone."""
    found = kept.read("members", only).groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("ids"))
    named = found.withColumn("canonical_id", F.coalesce(F.array_min(F.filter("ids", lambda x: x.like("CVE-%"))), F.array_min("ids")))
    return named.select("component", "canonical_id", F.array_remove("ids", F.col("canonical_id")).alias("aliases"))


def joined_records(known: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots whose identifiers belong to more than one stored vulnerability: they must not be stored unseen.

    ``known`` has ``canonical_id, aliases``. Returns ``snapshot_id, records``.
    """
    owned = known.select(F.col("canonical_id").alias("owner"), F.explode(F.array_append("aliases", F.col("canonical_id"))).alias("identifier"))
    named = snapshots.select("snapshot_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_id"))).alias("i")).select("snapshot_id", vulnerability_id(F.col("i")).alias("identifier"))
    return named.join(owned, "identifier").groupBy("snapshot_id").agg(F.count_distinct("owner").alias("records")).filter("records > 1")
