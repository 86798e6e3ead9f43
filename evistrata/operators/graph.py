"""Graph operators: components, temporal nodes and edges, candidates, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.components import connected as components
from evistrata.operators.graph_loaders import STRUCTURE, mapped
from evistrata.operators.reconcile import every, some
from evistrata.operators.revisions import RevisionSpec, effective, latest_by


def canonical_identifier(members: DataFrame) -> DataFrame:
    """For each component the smallest CVE identifier, or else the smallest of all."""
    return members.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("node").like("CVE-%"), F.col("node"))), F.min("node")).alias("canonical"), F.count("*").alias("members"))


def is_current(as_of: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open validity: from ``start`` on, before ``end``; a missing bound is open."""
    return F.coalesce(F.col(start) <= as_of, F.lit(True)) & F.coalesce(F.col(end) > as_of, F.lit(True))


def reconcile_nodes(snapshots: DataFrame, as_of: Column, spec: RevisionSpec = RevisionSpec()) -> DataFrame:
    """Nodes from their latest snapshots; an organization only if the current ones name a single one."""
    rows = latest_by(snapshots, spec).withColumn("_current", F.col("active") & is_current(as_of))
    organizations = F.collect_set(F.when(F.col("_current"), F.col("organization_id")))
    found = rows.groupBy("node_key").agg(
        F.max_by(F.struct("event_type", "title"), F.struct("modified_at", "snapshot_id")).alias("b"), organizations.alias("o"), F.max("confidence").alias("confidence"),
        F.count_distinct("source_id").alias("modules"), some(F.col("_current")).alias("current"), F.count("*").alias("snapshots"),
    )
    return found.select("node_key", F.col("b.event_type").alias("node_type"), F.col("b.title").alias("display_name"), F.when(F.size("o") == 1, F.get("o", F.lit(0))).alias("organization_id"), "confidence", "modules", "current", "snapshots")


def reconcile_edges(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Edges: superseded by any snapshot, last one wins ties, and an edge never loses all of its statements."""
    spec = RevisionSpec(supersedes="supersedes_record_key", from_all=True, fallback="event_key")
    rows = effective(snapshots, spec).withColumn("_current", F.col("active") & is_current(as_of) & ~F.col("claim_type").isin("dispute", "retraction") & F.coalesce(F.col("expires_at") > as_of, F.lit(True)))
    found = rows.groupBy("event_key").agg(
        F.collect_set(F.when(F.col("_current"), F.col("claim_type"))).alias("_now"), F.max_by("claim_type", F.struct("modified_at", "snapshot_id")).alias("_newest"), some(F.col("_current")).alias("current"),
        F.min("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"), F.max("confidence").alias("confidence"), F.count("*").alias("statements"), every(F.col("historical_only")).alias("historical_only"),
    )
    basis = F.when(F.size("_now") == 1, F.get("_now", F.lit(0))).when(F.size("_now") > 1, "multiple").otherwise(F.col("_newest"))
    return found.select("event_key", basis.alias("basis"), "current", "valid_from", "valid_until", "confidence", "statements", "historical_only")


def simple_name(name: str) -> Column:
    """Lower case, everything but a-z and 0-9 turned into single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", " "))


def match_candidates(identities: DataFrame, organizations: DataFrame) -> DataFrame:
    """Merge candidates by name: 0.92 if the postal code agrees too, else 0.75; best first per identity.

    An equi-join on the normalised name; nothing is compared pair by pair.
    """
    left = identities.select("identity_id", simple_name("name").alias("n"), F.col("postal_code").alias("p1"))
    right = organizations.select("organization_id", F.regexp_replace(simple_name("name"), r"( (sas|sa|sarl|gmbh|ltd|inc|llc))+$", "").alias("n"), F.col("postal_code").alias("p2"))
    score = F.when(F.col("p1") == F.col("p2"), 0.92).otherwise(0.75)
    met = left.join(right, "n").withColumn("score", score)
    w = Window.partitionBy("identity_id").orderBy(F.col("score").desc(), "organization_id")
    return met.select("identity_id", "organization_id", "score", F.row_number().over(w).alias("rank"))


def resolution_state(bindings: DataFrame, node: str) -> DataFrame:
    """One row: ``unbound`` or ``bound:organization:revision`` of the node's current binding."""
    bound = F.concat_ws(":", F.lit("bound"), F.col("organization_id").cast("string"), F.col("decision_id").cast("string"))
    return bindings.filter((F.col("node_key") == node) & F.col("current")).agg(F.coalesce(F.max(bound), F.lit("unbound")).alias("resolution_state_key"))


def blast_radius(nodes: DataFrame, edges: DataFrame, bindings: DataFrame, downstream: dict[str, Column | tuple[DataFrame, Column]], node: str, organization: int | None) -> DataFrame:
    """Counts of what a decision on ``node`` touches, with a fingerprint to be compared before it is applied.

    Nodes are the node and those of the organization, edges those with an end among them. ``downstream``
    names a table and the condition of its affected rows for each further count. Every count is an
    aggregate of one row, so joining them is no product of tables.
    """
    affected = nodes.filter((F.col("node_key") == node) | (F.lit(organization is not None) & F.coalesce(F.col("organization_id") == F.lit(organization), F.lit(False)))).select("node_key").distinct()
    ends = edges.select("edge_key", F.explode(F.array("source_node_key", "target_node_key")).alias("node_key"))
    parts = [resolution_state(bindings, node), affected.agg(F.count("*").alias("graph_nodes")), ends.join(affected, "node_key", "left_semi").agg(F.count_distinct("edge_key").alias("graph_edges"))]
    for name, (rows, condition) in downstream.items():
        parts.append(rows.filter(condition if organization is not None else F.lit(False)).agg(F.count("*").alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    target = "" if organization is None else f"organization:{organization}"
    names = ["graph_nodes", "graph_edges", *downstream]
    material = F.concat_ws("|", F.lit(node), F.lit(target), "resolution_state_key", *[F.col(n).cast("string") for n in names])
    total = sum((F.col(n) for n in downstream), F.lit(0))
    return out.withColumns({"downstream_records": total, "needs_confirmation": (F.col("graph_edges") > 0) | (total > 0), "fingerprint": F.sha2(material, 256)})


def structural_edge(relationship: Column) -> Column:
    """Kind of edge for a relationship between identities; null for one that is no part of a structure."""
    return mapped(F.lower(F.trim(relationship)), STRUCTURE)


def edges_of(edges: DataFrame, node: str, as_of: Column | None = None) -> DataFrame:
    """Edges at a node with their direction, at a time if one is given."""
    near = edges.filter((F.col("source_node_key") == node) | (F.col("target_node_key") == node))
    if as_of is not None:
        near = near.filter(F.coalesce("active", F.lit(True)) & is_current(as_of))
    return near.withColumn("direction", F.when(F.col("source_node_key") == node, "out").otherwise("in"))


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_key, violation``: ends that are no nodes, keys that changed their ends or kind."""
    ends = edges.select("edge_key", F.explode(F.array("source_node_key", "target_node_key")).alias("node_key")).join(nodes.select("node_key").distinct(), "node_key", "left_anti")
    missing = ends.select("edge_key").distinct().withColumn("violation", F.lit("missing node"))
    turned = edges.groupBy("edge_key").agg(F.count_distinct(F.struct("source_node_key", "target_node_key", "edge_type")).alias("n")).filter("n > 1")
    return missing.unionByName(turned.select("edge_key", F.lit("changed ends").alias("violation")))


def bind_nodes(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Reconciled nodes; an analyst's current binding overrides the organization that the sources tell."""
    b = bindings.filter("current").select("node_key", F.col("organization_id").alias("_bound"))
    return nodes.join(b, "node_key", "left").withColumn("organization_id", F.coalesce("_bound", "organization_id")).withColumn("bound", F.col("_bound").isNotNull()).drop("_bound")
