"""The corporate graph from its six families: node and edge snapshots by fixed kinds, keys and review states.

Each loader is a projection of its rows (and a join where two tables make one edge); ``load_all`` is their union, from which the
graph operators reconcile nodes and edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.functions.text import host_of
from evistrata.operators.lineage import small_tasks

NODE = ("node_key", "node_type", "display_name", "source_module", "source_record_key", "organization_id", "observed_at", "valid_from", "valid_until", "confidence", "active")
EDGE = ("edge_key", "source_node_key", "target_node_key", "edge_type", "source_module", "source_record_key", "evidence_class", "claim_type", "review_state", "observed_at", "valid_from", "valid_until", "expires_at", "confidence", "active", "supersedes_record_key")
_TYPES = {"observed_at": "timestamp_ntz", "valid_from": "timestamp_ntz", "valid_until": "timestamp_ntz", "expires_at": "timestamp_ntz", "confidence": "double", "active": "boolean"}
# Kinds of statements, kinds of edges by role and by relationship of identities, kinds of identity nodes, states of assessments that end.
CLAIMS = {"dispute": "dispute", "correction": "correction", "retraction": "retraction"}
INCIDENT_CLAIMS = {"denial": "dispute", "correction": "correction", "retraction": "retraction"}
ROLES = {
    "provider": "provides_to", "customer": "customer_of", "partner": "partner_of", "supplier": "supplies_to", "reseller": "resells_to", "distributor": "distributes_to", "integrator": "integrates_for", "auditor": "audits",
    "insurer": "insures", "mssp_mdr": "secures", "cloud_hosting_provider": "hosts_for", "technology_vendor": "provides_to", "subcontractor": "subcontracts_for", "other": "related_to",
}
STRUCTURE = {
    "establishment_of": "establishment_of", "headquarters_of": "establishment_of", "direct_parent": "parent_of", "ultimate_parent": "parent_of", "subsidiary": "subsidiary_of",
    "brand_of": "brand_of", "predecessor": "predecessor_of", "successor": "successor_of", "merged_into": "merged_into", "spin_off_of": "spin_off_of",
}
IDENTITIES = {"legal_unit": "organization", "establishment": "establishment", "brand": "brand", "group": "group"}
TERMINAL = ("not_applicable", "withdrawn", "superseded")
DOMAINS = ("domain", "hostname")
CONFIRMED = ("official_confirmation", "regulator_notice", "company_disclosure")
DOUBTED = ("speculation", "dispute")

Graph = tuple[DataFrame, DataFrame]


def mapped(column: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def _key(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shaped(rows: DataFrame, names: Sequence[str], **values: Column) -> DataFrame:
    """The columns ``names``: given ones, those that the rows have, null for the others."""
    pick = lambda n: values[n] if n in values else F.col(n) if n in rows.columns else F.lit(None)
    return rows.select(*[pick(n).cast(_TYPES.get(n, "string")).alias(n) for n in names])


def _have(rows: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in rows.columns else default


def exact() -> Column:
    return F.when(F.col("link_status") == "exact", F.col("organization_id"))


def _seen(rows: DataFrame) -> Column:
    return F.col("observed_at") if "observed_at" in rows.columns else F.col("modified_at")


def incidents(claims: DataFrame) -> Graph:
    """Incident nodes, inactive where the claim disputes or retracts, and confirmed edges to exactly linked organizations."""
    kind = mapped(F.col("claim_type"), INCIDENT_CLAIMS, "assertion")
    live = F.col("active") & ~F.col("historical_only")
    node = _key("incident:", F.col("incident_key"))
    nodes = _shaped(claims, NODE, node_key=node, node_type=F.lit("incident"), display_name=F.col("title"), source_module=F.lit("incident_intelligence"), organization_id=exact(), observed_at=F.col("modified_at"), active=live & ~kind.isin("retraction", "dispute"))
    edges = _shaped(
        claims.filter(exact().isNotNull()), EDGE, edge_key=_key("incident-organization:", F.col("incident_key"), ":", F.col("organization_id")), source_node_key=node, target_node_key=_key("organization:", F.col("organization_id")), edge_type=F.lit("incident_involves"),
        source_module=F.lit("incident_intelligence"), evidence_class=F.col("claim_type"), claim_type=kind, review_state=F.lit("confirmed"), observed_at=F.col("modified_at"), active=live,
    )
    return nodes, edges


def changes(claims: DataFrame) -> Graph:
    """Change nodes and edges to exactly linked organizations; the kind of claim tells the review state."""
    key = _key("material-change:", F.col("event_key"))
    kind = F.when(F.col("claim_type").isin("dispute", "correction", "retraction"), F.col("claim_type")).otherwise("assertion")
    review = F.when(F.col("claim_type").isin(*CONFIRMED), "confirmed").when(F.col("claim_type").isin(*DOUBTED), "review_required").when(F.col("claim_type") == "retraction", "rejected").otherwise("unreviewed")
    live, module = F.col("active") & ~F.col("historical_only"), F.lit("corporate_changes")
    nodes = _shaped(claims, NODE, node_key=key, node_type=F.lit("material_change"), display_name=F.col("title"), source_module=module, organization_id=exact(), observed_at=F.col("modified_at"), active=live)
    edges = _shaped(
        claims.filter(exact().isNotNull()), EDGE, edge_key=_key("material-change-organization:", F.col("event_key"), ":", F.col("organization_id")), source_node_key=key, target_node_key=_key("organization:", F.col("organization_id")),
        edge_type=F.lit("material_change_affects"), source_module=module, evidence_class=F.col("claim_type"), claim_type=kind, review_state=review, observed_at=F.col("modified_at"), active=live, valid_until=F.col("expires_at"),
    )
    return nodes, edges


def applicability(assessments: DataFrame, products: DataFrame, vulnerabilities: DataFrame) -> Graph:
    """Product and vulnerability nodes, an edge from each assessed vulnerability to its asset, and one from the asset to the matched product.

    ``assessments`` has ``identity_key, snapshot_key, asset_id, vulnerability_id, matched_product_key, state, precision, confidence,
    assessed_at``; each supersedes the one before it of its identity. ``products`` has ``product_key, vendor, product, updated_at`` (and
    ``component``), ``vulnerabilities`` has ``vulnerability_id, canonical_id, status, published_at, updated_at``.
    """
    module, state = F.lit("vulnerability_applicability"), F.col("state")
    before = Window.partitionBy("identity_key").orderBy("assessed_at", "snapshot_key")
    record = _key("assessment:", F.col("identity_key"), ":", F.col("snapshot_key"))
    rows = assessments.withColumn("_record", record).withColumn("_before", F.lag("_record").over(before))
    ended = state.isin(*TERMINAL)
    review = F.when(state == "applicable", "confirmed").when(state.isin("review_required", "potentially_applicable", "unknown"), "review_required").when(ended, "rejected").otherwise("unreviewed")
    asset = _key("asset:", F.col("asset_id"))
    common = {"source_module": module, "claim_type": F.when(ended, "retraction").otherwise("assertion"), "review_state": review, "observed_at": F.col("assessed_at"), "active": ~ended}
    edges = _shaped(
        rows, EDGE, edge_key=_key("applicability:", F.col("identity_key")), source_node_key=_key("vulnerability:", F.col("vulnerability_id")), target_node_key=asset, edge_type=F.lit("vulnerability_applies_to"), source_record_key=F.col("_record"),
        evidence_class=_key("applicability:", state, ":", F.col("precision")), supersedes_record_key=F.col("_before"), **common,
    )
    used = _shaped(
        rows.filter("matched_product_key is not null"), EDGE, edge_key=_key("asset-product:", F.col("asset_id"), ":", F.col("matched_product_key")), source_node_key=asset, target_node_key=_key("product:", F.col("matched_product_key")),
        edge_type=F.lit("uses_product"), source_record_key=_key(F.col("_record"), ":product"), evidence_class=_key("product_match:", F.col("precision")), supersedes_record_key=_key(F.col("_before"), ":product"), **common,
    )
    part = F.concat_ws(" / ", F.concat_ws(" ", "vendor", "product"), F.col("component") if "component" in products.columns else F.lit(None).cast("string"))
    nodes = _shaped(products, NODE, node_key=_key("product:", F.col("product_key")), node_type=F.lit("product"), display_name=part, source_module=module, source_record_key=F.col("product_key"), observed_at=F.col("updated_at"), confidence=F.lit(1.0), active=F.lit(True))
    known = _shaped(vulnerabilities, NODE, node_key=_key("vulnerability:", F.col("vulnerability_id")), node_type=F.lit("vulnerability"), display_name=F.col("canonical_id"), source_module=F.lit("vulnerability_knowledge"), source_record_key=F.col("canonical_id"), observed_at=F.col("updated_at"), valid_from=F.col("published_at"), confidence=F.lit(1.0), active=~F.coalesce(F.col("status").isin("withdrawn", "rejected"), F.lit(False)))
    return nodes.unionByName(known), edges.unionByName(used)


def passive(observations: DataFrame, technologies: DataFrame) -> Graph:
    """Asset and technology nodes, confirmed attribution edges from exactly linked organizations, and edges to the technologies seen.

    ``observations`` has ``snapshot_id, asset_key, source_record_key, supersedes_record_key, organization_id, link_status, expires_at,
    confidence, active, historical_only`` (and ``asset_kind, asset_value, link_confidence``); ``technologies`` has ``snapshot_id,
    technology_key`` (and ``product_name, product_version, evidence_level``).
    """
    module, live = F.lit("passive_exposure"), F.col("active") & ~F.col("historical_only")
    rows = observations.withColumns({"asset_kind": _have(observations, "asset_kind", F.lit("asset")), "asset_value": _have(observations, "asset_value", F.col("asset_key").cast("string")), "link_confidence": _have(observations, "link_confidence", F.col("confidence"))})
    asset, at = _key("asset:", F.col("asset_key")), _seen(rows)
    domain = F.col("asset_kind").isin(*DOMAINS)
    nodes = _shaped(rows, NODE, node_key=asset, node_type=F.when(domain, "domain").otherwise("asset"), display_name=F.col("asset_value"), source_module=module, organization_id=exact(), observed_at=at, valid_from=F.lit(None), valid_until=F.col("expires_at"), active=live)
    edges = _shaped(
        rows.filter(exact().isNotNull()), EDGE, edge_key=_key("passive-attribution:", F.col("organization_id"), ":", F.col("asset_key")), source_node_key=_key("organization:", F.col("organization_id")), target_node_key=asset,
        edge_type=F.when(domain, "uses_domain").otherwise("owns_asset"), source_module=module, evidence_class=F.lit("passive_attribution"), claim_type=F.lit("assertion"), review_state=F.lit("confirmed"), observed_at=at, valid_from=F.lit(None),
        valid_until=F.col("expires_at"), confidence=F.least("confidence", "link_confidence"), active=live,
    )
    seen = technologies.select("snapshot_id", "technology_key", *[_have(technologies, c, F.lit(None).cast("string")).alias(c) for c in ("product_name", "product_version", "evidence_level")]).hint("shuffle_hash").join(rows, "snapshot_id")  # neither side is sorted
    technology, key = _key("technology:", F.col("technology_key")), F.col("technology_key")
    shown = F.concat_ws(" ", F.coalesce("product_name", "technology_key"), "product_version")
    more = _shaped(seen, NODE, node_key=technology, node_type=F.lit("technology"), display_name=shown, source_module=module, source_record_key=_key(F.col("source_record_key"), ":", key), organization_id=exact(), observed_at=at, valid_from=F.lit(None), valid_until=F.col("expires_at"), active=live)
    runs = _shaped(
        seen, EDGE, edge_key=_key("asset-technology:", F.col("asset_key"), ":", key), source_node_key=asset, target_node_key=technology, edge_type=F.lit("uses_technology"), source_module=module, source_record_key=_key(F.col("source_record_key"), ":", key),
        evidence_class=F.col("evidence_level"), claim_type=F.lit("assertion"), review_state=F.lit("unreviewed"), observed_at=at, valid_from=F.lit(None), valid_until=F.col("expires_at"), active=live, supersedes_record_key=_key(F.col("supersedes_record_key"), ":", key),
    )
    return nodes.unionByName(more), edges.unionByName(runs)


def relationships(evidence: DataFrame) -> Graph:
    """Endpoint nodes, a relation edge by role, and an identity edge for each endpoint that names an organization."""
    module, claim = F.lit("relationship_intelligence"), mapped(F.col("claim_type"), CLAIMS, "assertion")
    end = lambda side: _key("relationship-endpoint:", F.col("relationship_key"), f":{side}")
    states = F.array("source_link_status", "target_link_status")
    weak = F.arrays_overlap(states, F.array(*map(F.lit, ("candidate", "review_required", "unresolved"))))
    review = (
        F.when(F.array_contains(states, "rejected"), "rejected").when(weak, "review_required").when(F.col("evidence_class").isin("observed", "contracted"), "confirmed").when(F.col("evidence_class") == "inferred", "review_required").otherwise("unreviewed")
    )
    org = lambda side: F.col(f"{side}_organization_id")
    status = lambda side: F.col(f"{side}_link_status")
    nodes = None
    for side in ("source", "target"):
        name = _have(evidence, f"claimed_{side}_organization_name", F.coalesce(_key("Resolved organization ", org(side)), F.lit("Unresolved organization")))
        mine = _shaped(evidence, NODE, node_key=end(side), node_type=F.lit("organization"), display_name=name, source_module=module, source_record_key=_key(F.col("source_record_key"), f":{side}"), organization_id=org(side))
        nodes = mine if nodes is None else nodes.unionByName(mine)

    # each row of evidence is read once and gives up to three edges
    part = F.col("_edge")
    each = evidence.withColumn("_edge", F.explode(F.array(*map(F.lit, ("relation", "source", "target"))))).filter((part == "relation") | F.when(part == "source", org("source").isNotNull()).otherwise(org("target").isNotNull()))
    pick = lambda relation, bound: F.when(part == "relation", relation).when(part == "source", bound("source")).otherwise(bound("target"))
    given = lambda c: F.col(c) if c in evidence.columns else F.lit(None)
    edges = _shaped(
        each, EDGE, edge_key=pick(_key("business-relationship:", F.col("relationship_key")), lambda s: _key("relationship-endpoint-binding:", F.col("relationship_key"), f":{s}:", org(s))), source_node_key=pick(end("source"), end),
        target_node_key=pick(end("target"), lambda s: _key("organization:", org(s))), edge_type=pick(mapped(F.col("role"), ROLES, "related_to"), lambda s: F.lit("identity_of")), source_module=module, claim_type=claim,
        source_record_key=pick(given("source_record_key"), lambda s: _key(F.col("source_record_key"), f":{s}:identity")), evidence_class=pick(given("evidence_class"), lambda s: F.lit("endpoint_resolution")),
        supersedes_record_key=pick(given("supersedes_record_key"), lambda s: _key(F.col("supersedes_record_key"), f":{s}:identity")),
        review_state=pick(review, lambda s: F.when(status(s) == "exact", "confirmed").when(status(s) == "rejected", "rejected").otherwise("review_required")),
        active=pick(F.col("active") & ~F.col("historical_only"), lambda s: given("active").cast("boolean")),
    )
    return nodes, edges


def organizations(rows: DataFrame) -> Graph:
    """Organization nodes and their references: website domain (unreviewed), legal alias and identifiers (for review where several hold them).

    ``rows`` has ``organization_id, canonical_name, legal_name, website_url, registration_ids, created_at, updated_at``.
    """
    module, org = F.lit("organizations"), F.col("organization_id")
    since = {"source_module": module, "observed_at": F.col("updated_at"), "valid_from": F.col("created_at"), "confidence": F.lit(1.0), "active": F.lit(True)}
    nodes = _shaped(rows, NODE, node_key=_key("organization:", org), node_type=F.lit("organization"), display_name=F.col("canonical_name"), source_record_key=org, **since)
    sites = rows.withColumn("domain", host_of(F.col("website_url"))).filter("domain is not null")
    record = _key("organization-website:", org, ":", F.col("domain"))
    here = {"source_module": module, "source_record_key": record, "observed_at": F.col("updated_at"), "confidence": F.lit(0.9), "active": F.lit(True), "valid_from": F.lit(None)}
    nodes = nodes.unionByName(_shaped(sites, NODE, node_key=_key("domain:", F.col("domain")), node_type=F.lit("domain"), display_name=F.col("domain"), **here))
    edges = _shaped(sites, EDGE, edge_key=_key("organization-domain:", org, ":", F.col("domain")), source_node_key=_key("organization:", org), target_node_key=_key("domain:", F.col("domain")), edge_type=F.lit("uses_domain"), evidence_class=F.lit("declared_website"), claim_type=F.lit("assertion"), review_state=F.lit("unreviewed"), **here)
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    aliases = rows.withColumn("text", normal("legal_name")).filter(F.col("text").isNotNull() & (F.col("text") != "") & (F.col("text") != F.coalesce(normal("canonical_name"), F.lit("")))).withColumns({"shown": F.coalesce("legal_name", "canonical_name")})
    ids = rows.withColumn("raw", F.explode("registration_ids")).withColumn("text", F.lower(F.trim("raw"))).filter("text <> ''").withColumn("shown", F.col("text"))
    for refs, prefix, record, kind, edge, evidence in ((aliases, "alias", "legal-name", "alias", "alias_of", "canonical_legal_alias"), (ids, "identifier", "registration-id", "identifier", "identifies", "registration_identifier")):
        shared = refs.groupBy("text").agg(F.count("*").alias("holders")).filter("holders > 1")  # most texts have one holder and meet nothing
        met = refs.join(shared, "text", "left").withColumns({"_node": _key(f"{prefix}:", F.sha2("text", 256)), "_record": _key(f"{record}:", org, ":", F.col("text"))})
        nodes = nodes.unionByName(_shaped(met, NODE, node_key=F.col("_node"), node_type=F.lit(kind), display_name=F.col("shown"), source_record_key=F.col("_record"), **since))
        edges = edges.unionByName(_shaped(
            met, EDGE, edge_key=_key(f"{edge}-organization:", F.col("_node"), ":", org), source_node_key=F.col("_node"), target_node_key=_key("organization:", org), edge_type=F.lit(edge), source_record_key=F.col("_record"), evidence_class=F.lit(evidence),
            claim_type=F.lit("assertion"), review_state=F.when(F.col("holders") > 1, "review_required").otherwise("confirmed"), **since | {"valid_from": F.lit(None)},
        ))
    return nodes, edges


def identities(rows: DataFrame, relations: DataFrame) -> Graph:
    """Identity nodes by kind, confirmed edges to the bound organization, and confirmed structural edges between identities.

    ``rows`` has ``identity_id, kind, name, organization_id`` (and ``status, confidence`` and times); ``relations`` has ``relation_id,
    source_identity_id, target_identity_id, relationship_type``. Relationships that are no part of a structure give no edge.
    """
    module = F.lit("organization_identity")
    of = lambda c: _key("identity:", F.col(c))
    nodes = _shaped(rows, NODE, node_key=of("identity_id"), node_type=mapped(F.col("kind"), IDENTITIES, "organization"), display_name=F.col("name"), source_module=module, source_record_key=F.col("identity_id"), active=_have(rows, "status", F.lit("active")) != "inactive")
    binding = _key("identity-binding:", F.col("identity_id"), ":", F.col("organization_id"))
    sure = {"source_module": module, "claim_type": F.lit("assertion"), "review_state": F.lit("confirmed"), "active": F.lit(True)}
    edges = _shaped(rows.filter("organization_id is not null"), EDGE, edge_key=binding, source_node_key=of("identity_id"), target_node_key=_key("organization:", F.col("organization_id")), edge_type=F.lit("identity_of"), source_record_key=binding, evidence_class=F.lit("resolved_identity"), **sure)
    tied = relations.withColumn("_t", mapped(F.lower(F.trim("relationship_type")), STRUCTURE)).filter("_t is not null")
    key = _key("identity-relationship:", F.col("source_identity_id"), ":", F.col("target_identity_id"), ":", F.col("relationship_type"))
    more = _shaped(tied, EDGE, edge_key=key, source_node_key=of("source_identity_id"), target_node_key=of("target_identity_id"), edge_type=F.col("_t"), source_record_key=F.col("relation_id"), evidence_class=F.lit("structural_claim"), **sure)
    return nodes, edges.unionByName(more)


def load_all(*parts: Graph) -> Graph:
    """All nodes and all edges of several loaders; a task groups the edge keys of what it reads, so it is given a bounded part."""
    nodes, edges = parts[0]
    small_tasks(nodes.sparkSession)
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def review_states(edges: DataFrame) -> DataFrame:
    """Per edge: a review that one statement asks for, rejected if all are, else the best of confirmed, auto_confirmed, unreviewed."""
    s = F.col("review_state")
    any_ = lambda v: F.coalesce(F.bool_or(s == v), F.lit(False))
    state = F.when(any_("review_required"), "review_required").when(F.coalesce(F.bool_and(s == "rejected"), F.lit(False)), "rejected").when(any_("confirmed"), "confirmed").when(any_("auto_confirmed"), "auto_confirmed").otherwise("unreviewed")
    return edges.groupBy("edge_key").agg(state.alias("review_state"))


def settled(graph: Graph, as_of: Column) -> Graph:
    """Nodes and edges, one row each: nodes by their newest snapshot, edges by the statements that count.

    Of an edge the latest statement of each record counts unless any statement of its module supersedes the record; an edge is never left
    without one. It holds at ``as_of`` if a counting assertion is active and its time has come and not gone.
    """
    nodes, edges = graph
    order = F.struct("observed_at", "source_module", "source_record_key")
    shown = nodes.groupBy("node_key").agg(F.max_by(F.struct("node_type", "display_name"), order).alias("n"), F.array_sort(F.collect_set("organization_id")).alias("_orgs"), F.bool_or("active").alias("active"), F.count("*").alias("snapshots"))
    shown = shown.select("node_key", "n.*", F.when(F.size("_orgs") == 1, F.get("_orgs", F.lit(0))).alias("organization_id"), "active", "snapshots")
    record = ["edge_key", "source_module", "source_record_key"]
    names = [c for c in edges.columns if c not in record]
    latest = edges.groupBy(*record).agg(F.max_by(F.struct(*names), F.struct("observed_at", "active")).alias("r")).select(*record, "r.*")
    gone = edges.filter("supersedes_record_key is not null").select("edge_key", "source_module", F.col("supersedes_record_key").alias("source_record_key"), F.lit(True).alias("_gone")).distinct()
    marked = latest.join(gone, record, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    left = F.count(F.when(~F.col("_gone"), 1)).over(Window.partitionBy("edge_key"))
    newest = F.row_number().over(Window.partitionBy("edge_key").orderBy(F.col("observed_at").desc_nulls_last(), "source_module", "source_record_key"))
    counting = marked.withColumns({"_left": left, "_n": newest}).filter((F.col("_left") > 0) & ~F.col("_gone") | (F.col("_left") == 0) & (F.col("_n") == 1))
    begun, over = F.coalesce(F.col("valid_from") <= as_of, F.lit(True)), F.coalesce(F.col("valid_until") <= as_of, F.lit(False)) | F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    holds = F.coalesce("active", F.lit(True)) & begun & ~over & ~F.col("claim_type").isin("dispute", "retraction")
    ends = counting.groupBy("edge_key").agg(F.max_by(F.struct("source_node_key", "target_node_key", "edge_type"), "observed_at").alias("e"), F.bool_or(holds).alias("current"), F.max("confidence").alias("confidence"), F.count("*").alias("statements"))
    return shown, ends.select("edge_key", "e.*", "current", "confidence", "statements").join(review_states(counting), "edge_key")


def node_detail(nodes: DataFrame, edges: DataFrame, node_key: str, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One node as of a time: the node, its snapshots (newest first is the caller's order), and its edges with their direction.

    With ``as_of`` only what was observed by then counts, and only edges that hold at that time are shown.
    """
    at = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    known = lambda d: d if as_of is None else d.filter(F.col("observed_at") <= as_of)
    mine = known(nodes.filter(F.col("node_key") == node_key))
    near = known(edges.filter((F.col("source_node_key") == node_key) | (F.col("target_node_key") == node_key)))
    node, shown = settled((mine, near), at)
    shown = shown if as_of is None else shown.filter("current")
    return node, mine, shown.withColumn("direction", F.when(F.col("source_node_key") == node_key, "out").otherwise("in"))
