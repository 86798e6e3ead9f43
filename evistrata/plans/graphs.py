"""Registered queries over the corporate graph: its six loaders, their union, review states, one node at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import graph_loaders as load
from evistrata.plans.bindings import AS_OF, sql, table, view
from evistrata.plans.evidence import as_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


SHOWN = ("edge_key", "edge_type", "source_node_key", "target_node_key", "claim_type", "review_state", "active", "supersedes_record_key")


def _shown(edges):
    return edges.select(*SHOWN)


INCIDENT = """SELECT 'incident-organization:' || incident_key || ':' || organization_id AS edge_key, 'incident_involves' AS edge_type, 'incident:' || incident_key AS source_node_key, 'organization:' || organization_id AS target_node_key,
    CASE claim_type WHEN 'denial' THEN 'dispute' WHEN 'correction' THEN 'correction' WHEN 'retraction' THEN 'retraction' ELSE 'assertion' END AS claim_type, 'confirmed' AS review_state, active AND NOT historical_only AS active, NULL::varchar AS supersedes_record_key
    FROM v_claim WHERE link_status = 'exact' AND organization_id IS NOT NULL"""
CHANGE = """SELECT 'material-change-organization:' || event_key || ':' || organization_id AS edge_key, 'material_change_affects' AS edge_type, 'material-change:' || event_key AS source_node_key, 'organization:' || organization_id AS target_node_key,
    CASE WHEN claim_type IN ('dispute', 'correction', 'retraction') THEN claim_type ELSE 'assertion' END AS claim_type,
    CASE WHEN claim_type IN ('official_confirmation', 'regulator_notice', 'company_disclosure') THEN 'confirmed' WHEN claim_type IN ('speculation', 'dispute') THEN 'review_required' WHEN claim_type = 'retraction' THEN 'rejected' ELSE 'unreviewed' END AS review_state,
    active AND NOT historical_only AS active, supersedes_record_key FROM v_change WHERE link_status = 'exact' AND organization_id IS NOT NULL"""
CHANGE = CHANGE.replace("FROM v_change", "FROM (SELECT * REPLACE (CASE WHEN claim_type = 'official_announcement' THEN 'regulator_notice' ELSE claim_type END AS claim_type) FROM v_change)")
RELATION = """SELECT 'business-relationship:' || relationship_key AS edge_key, CASE role WHEN 'supplier' THEN 'supplies_to' WHEN 'partner' THEN 'partner_of' ELSE 'related_to' END AS edge_type, 'relationship-endpoint:' || relationship_key || ':source' AS source_node_key,
    'relationship-endpoint:' || relationship_key || ':target' AS target_node_key, claim_type, CASE WHEN source_link_status <> 'exact' OR target_link_status <> 'exact' OR evidence_class = 'inferred' THEN 'review_required' WHEN evidence_class IN ('observed', 'contracted') THEN 'confirmed' ELSE 'unreviewed' END AS review_state,
    active AND NOT historical_only AS active, supersedes_record_key FROM v_relationship
    UNION ALL SELECT 'relationship-endpoint-binding:' || relationship_key || ':source:' || source_organization_id, 'identity_of', 'relationship-endpoint:' || relationship_key || ':source', 'organization:' || source_organization_id, claim_type,
        CASE source_link_status WHEN 'exact' THEN 'confirmed' ELSE 'review_required' END, active, supersedes_record_key || ':source:identity' FROM v_relationship
    UNION ALL SELECT 'relationship-endpoint-binding:' || relationship_key || ':target:' || target_organization_id, 'identity_of', 'relationship-endpoint:' || relationship_key || ':target', 'organization:' || target_organization_id, claim_type,
        CASE target_link_status WHEN 'exact' THEN 'confirmed' ELSE 'review_required' END, active, supersedes_record_key || ':target:identity' FROM v_relationship"""
STATE = "CASE event_type WHEN 'view' THEN 'applicable' WHEN 'error' THEN 'withdrawn' WHEN 'click' THEN 'potentially_applicable' WHEN 'signup' THEN 'superseded' ELSE 'not_applicable' END"
ASSESSED = f"(SELECT event_id AS n, (user_id % 80)::varchar AS identity_key, 'k' || event_id AS snapshot_key, user_id % 50 AS asset_id, user_id % 80 AS vulnerability_id, CASE WHEN event_id % 3 <> 0 THEN 'prod' || (user_id % 10) END AS product_key, {STATE} AS state, ts AS assessed_at FROM events)"
APPLIES = f"""SELECT * FROM (WITH a AS (SELECT *, 'assessment:' || identity_key || ':' || snapshot_key AS record, CASE WHEN state = 'applicable' THEN 'confirmed' WHEN state = 'potentially_applicable' THEN 'review_required' ELSE 'rejected' END AS review_state,
        state IN ('not_applicable', 'withdrawn', 'superseded') AS ended FROM {ASSESSED}),
    b AS (SELECT *, lag(record) OVER (PARTITION BY identity_key ORDER BY assessed_at, snapshot_key) AS earlier FROM a)
    SELECT 'applicability:' || identity_key AS edge_key, 'vulnerability_applies_to' AS edge_type, 'vulnerability:' || vulnerability_id AS source_node_key, 'asset:' || asset_id AS target_node_key, CASE WHEN ended THEN 'retraction' ELSE 'assertion' END AS claim_type, review_state, NOT ended AS active, earlier AS supersedes_record_key FROM b
    UNION ALL SELECT 'asset-product:' || asset_id || ':' || product_key, 'uses_product', 'asset:' || asset_id, 'product:' || product_key, CASE WHEN ended THEN 'retraction' ELSE 'assertion' END, review_state, NOT ended, earlier || ':product' FROM b WHERE product_key IS NOT NULL)"""
PASSIVE = """SELECT 'passive-attribution:' || organization_id || ':' || asset_key AS edge_key, CASE WHEN asset_key % 4 = 0 THEN 'uses_domain' ELSE 'owns_asset' END AS edge_type, 'organization:' || organization_id AS source_node_key, 'asset:' || asset_key AS target_node_key,
    'assertion' AS claim_type, 'confirmed' AS review_state, active AND NOT historical_only AS active, supersedes_record_key FROM v_change WHERE link_status = 'exact' AND organization_id IS NOT NULL
    UNION ALL SELECT 'asset-technology:' || asset_key || ':t' || (snapshot_id % 12), 'uses_technology', 'asset:' || asset_key, 'technology:t' || (snapshot_id % 12), 'assertion', 'unreviewed', active AND NOT historical_only, supersedes_record_key || ':t' || (snapshot_id % 12) FROM v_change"""
IDENTITY = """SELECT 'identity-binding:' || s_suppkey || ':' || s_nationkey AS edge_key, 'identity_of' AS edge_type, 'identity:' || s_suppkey AS source_node_key, 'organization:' || s_nationkey AS target_node_key, 'assertion' AS claim_type, 'confirmed' AS review_state, true AS active, NULL::varchar AS supersedes_record_key FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'identity-relationship:' || s_suppkey || ':' || (s_suppkey + 1) || ':' || raw, kind, 'identity:' || s_suppkey, 'identity:' || (s_suppkey + 1), 'assertion', 'confirmed', true, NULL FROM (
        SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'direct_parent' WHEN 1 THEN ' Subsidiary ' WHEN 2 THEN 'merged_into' WHEN 4 THEN 'brand_of' END AS raw, CASE s_suppkey % 5 WHEN 0 THEN 'parent_of' WHEN 1 THEN 'subsidiary_of' WHEN 2 THEN 'merged_into' WHEN 4 THEN 'brand_of' END AS kind FROM supplier) WHERE kind IS NOT NULL"""
REFERENCE = """SELECT * FROM (WITH o AS (SELECT c_custkey AS org, c_name AS canonical, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Acme  Group ' || (c_custkey % 700) ELSE c_name || ' ' END AS legal, CASE WHEN c_custkey % 4 <> 0 THEN 'https://www.Site' || (c_custkey % 900) || '.org/x' END AS site, [' ID' || (c_custkey % 1000), 'U' || c_custkey] AS ids FROM customer),
    a AS (SELECT org, trim(regexp_replace(lower(legal), '\\s+', ' ', 'g')) AS t FROM o WHERE legal IS NOT NULL AND trim(regexp_replace(lower(legal), '\\s+', ' ', 'g')) <> lower(canonical)), i AS (SELECT org, lower(trim(unnest(ids))) AS t FROM o)
    SELECT 'organization-domain:' || org || ':site' || (org % 900) || '.org' AS edge_key, 'uses_domain' AS edge_type, 'organization:' || org AS source_node_key, 'domain:site' || (org % 900) || '.org' AS target_node_key, 'assertion' AS claim_type, 'unreviewed' AS review_state, true AS active, NULL::varchar AS supersedes_record_key FROM o WHERE site IS NOT NULL
    UNION ALL SELECT 'alias_of-organization:alias:' || sha256(t) || ':' || org, 'alias_of', 'alias:' || sha256(t), 'organization:' || org, 'assertion', CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN 'review_required' ELSE 'confirmed' END, true, NULL FROM a
    UNION ALL SELECT 'identifies-organization:identifier:' || sha256(t) || ':' || org, 'identifies', 'identifier:' || sha256(t), 'organization:' || org, 'assertion', CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN 'review_required' ELSE 'confirmed' END, true, NULL FROM i)"""
ALL = {"incident": INCIDENT, "change": CHANGE, "relation": RELATION, "applies": APPLIES, "passive": PASSIVE, "identity": IDENTITY, "reference": REFERENCE}


def _incidents(spark, sf_dir):
    return load.incidents(view(spark, sf_dir, "v_claim"))


def _changes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_change")  # an official announcement is a regulator's notice here
    return load.changes(rows.withColumn("claim_type", F.when(F.col("claim_type") == "official_announcement", "regulator_notice").otherwise(F.col("claim_type"))))


def _applicability(spark, sf_dir):
    e, u, t = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type")
    state = F.when(t == "view", "applicable").when(t == "error", "withdrawn").when(t == "click", "potentially_applicable").when(t == "signup", "superseded").otherwise("not_applicable")
    product = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("prod"), (u % 10).cast("string")))
    rows = e.select((u % 80).cast("string").alias("identity_key"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("snapshot_key"), (u % 50).alias("asset_id"), (u % 80).alias("vulnerability_id"), product.alias("matched_product_key"), state.alias("state"), F.lit("version").alias("precision"), F.lit(0.5).alias("confidence"), F.col("ts").alias("assessed_at"))
    products = e.groupBy(F.concat(F.lit("prod"), (u % 10).cast("string")).alias("product_key")).agg(F.lit("v").alias("vendor"), F.lit("p").alias("product"), F.max("ts").alias("updated_at"))
    known = e.groupBy((u % 80).alias("vulnerability_id")).agg(F.lit("CVE").alias("canonical_id"), F.lit("published").alias("status"), F.min("ts").alias("published_at"), F.max("ts").alias("updated_at"))
    return load.applicability(rows, products, known)


def _passive(spark, sf_dir):
    v = view(spark, sf_dir, "v_change").withColumn("asset_kind", F.when(F.col("asset_key") % 4 == 0, "hostname").otherwise("address"))
    return load.passive(v, v.select("snapshot_id", F.concat(F.lit("t"), (F.col("snapshot_id") % 12).cast("string")).alias("technology_key")))


def _identities(spark, sf_dir):
    s, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    kind = F.when(s % 5 == 0, "direct_parent").when(s % 5 == 1, " Subsidiary ").when(s % 5 == 2, "merged_into").when(s % 5 == 3, "friend_of").otherwise("brand_of")
    identities = rows.select(s.alias("identity_id"), F.lit("legal_unit").alias("kind"), F.col("s_name").alias("name"), F.when(s % 2 == 0, F.col("s_nationkey")).alias("organization_id"))
    return load.identities(identities, rows.select(s.alias("relation_id"), s.alias("source_identity_id"), (s + 1).alias("target_identity_id"), kind.alias("relationship_type")))


def _organizations(spark, sf_dir):
    k = F.col("c_custkey")
    legal = F.when(k % 3 == 1, F.concat(F.lit("Acme  Group "), (k % 700).cast("string"))).when(k % 3 == 2, F.concat("c_name", F.lit(" ")))
    site = F.when(k % 4 != 0, F.concat(F.lit("https://www.Site"), (k % 900).cast("string"), F.lit(".org/x")))
    ids = F.array(F.concat(F.lit(" ID"), (k % 1000).cast("string")), F.concat(F.lit("U"), k.cast("string")))
    at = F.lit(None).cast("timestamp_ntz")
    return load.organizations(table(spark, sf_dir, "customer").select(k.alias("organization_id"), F.col("c_name").alias("canonical_name"), legal.alias("legal_name"), site.alias("website_url"), ids.alias("registration_ids"), at.alias("created_at"), at.alias("updated_at")))


def _everything(spark, sf_dir):
    """The six families in their order; references and identities are the organizations' two parts."""
    parts = (_organizations, _identities, lambda s, d: load.relationships(view(s, d, "v_relationship")), _passive, _incidents, _changes, _applicability)
    return load.load_all(*[f(spark, sf_dir) for f in parts])


@registered(INCIDENT)
def incident_edges(spark, sf_dir):
    return _shown(_incidents(spark, sf_dir)[1])


@registered(CHANGE)
def change_edges(spark, sf_dir):
    return _shown(_changes(spark, sf_dir)[1])


@registered(APPLIES)
def applicability_edges(spark, sf_dir):
    return _shown(_applicability(spark, sf_dir)[1])


@registered(PASSIVE)
def passive_edges(spark, sf_dir):
    return _shown(_passive(spark, sf_dir)[1])


@registered(IDENTITY)
def identity_edges(spark, sf_dir):
    return _shown(_identities(spark, sf_dir)[1])


@registered(REFERENCE)
def shared_references(spark, sf_dir):
    """Domains, aliases and identifiers of organizations."""
    return _shown(_organizations(spark, sf_dir)[1])


@registered(RELATION)
def relationship_edges(spark, sf_dir):
    return _shown(load.relationships(view(spark, sf_dir, "v_relationship"))[1])


@registered("""SELECT 'relationship-endpoint:' || relationship_key || ':source' AS node_key, 'Resolved organization ' || source_organization_id AS display_name, source_organization_id::varchar AS organization_id, source_record_key || ':source' AS source_record_key, active FROM v_relationship
    UNION ALL SELECT 'relationship-endpoint:' || relationship_key || ':target', 'Resolved organization ' || target_organization_id, target_organization_id::varchar, source_record_key || ':target', active FROM v_relationship""")
def relationship_nodes(spark, sf_dir):
    return load.relationships(view(spark, sf_dir, "v_relationship"))[0].select("node_key", "display_name", "organization_id", "source_record_key", "active")


@registered(f"""SELECT edge_key, CASE WHEN bool_or(review_state = 'review_required') THEN 'review_required' WHEN bool_and(review_state = 'rejected') THEN 'rejected' WHEN bool_or(review_state = 'confirmed') THEN 'confirmed' WHEN bool_or(review_state = 'auto_confirmed') THEN 'auto_confirmed' ELSE 'unreviewed' END AS review_state
    FROM ({' UNION ALL '.join(f'({x})' for x in ALL.values())}) GROUP BY edge_key""")
def edge_review_states(spark, sf_dir):
    return load.review_states(_everything(spark, sf_dir)[1])


@registered(f"SELECT edge_type, count(*) AS statements, count(DISTINCT edge_key) AS edges FROM ({' UNION ALL '.join(f'({x})' for x in ALL.values())}) GROUP BY edge_type")
def graph_refresh(spark, sf_dir):
    """All loaders as one graph: statements and edges of each kind."""
    return _everything(spark, sf_dir)[1].groupBy("edge_type").agg(F.count("*").alias("statements"), F.count_distinct("edge_key").alias("edges"))


@registered(f"""WITH e AS (SELECT 'asset-technology:' || asset_key || ':t' || (snapshot_id % 12) AS edge_key, 'out' AS direction, source_record_key || ':t' || (snapshot_id % 12) AS record, supersedes_record_key || ':t' || (snapshot_id % 12) AS gone, modified_at, expires_at, active AND NOT historical_only AS active FROM v_change WHERE asset_key = 12 AND modified_at <= {AS_OF}
        UNION ALL SELECT 'passive-attribution:' || organization_id || ':' || asset_key, 'in', source_record_key, supersedes_record_key, modified_at, expires_at, active AND NOT historical_only FROM v_change WHERE asset_key = 12 AND modified_at <= {AS_OF} AND link_status = 'exact' AND organization_id IS NOT NULL),
    l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY edge_key, record ORDER BY modified_at DESC, active DESC) = 1),
    m AS (SELECT l.*, EXISTS (SELECT 1 FROM e x WHERE x.edge_key = l.edge_key AND x.gone = l.record) AS dead FROM l),
    k AS (SELECT *, count(*) FILTER (NOT dead) OVER (PARTITION BY edge_key) AS alive, row_number() OVER (PARTITION BY edge_key ORDER BY modified_at DESC, record) AS n FROM m)
    SELECT edge_key, any_value(direction) AS direction, count(*) AS statements FROM k WHERE (alive > 0 AND NOT dead) OR (alive = 0 AND n = 1) GROUP BY edge_key HAVING bool_or(active AND NOT coalesce(expires_at <= {AS_OF}, false))""")
def graph_as_of(spark, sf_dir):
    """Edges of one asset as they held at a time, with their direction."""
    nodes, edges = _passive(spark, sf_dir)
    return load.node_detail(nodes, edges, "asset:12", as_of())[2].select("edge_key", "direction", "statements")


@registered(f"SELECT 'asset:12' AS node_key, 'asset' AS node_type, count(*) AS snapshots, bool_or(active AND NOT historical_only) AS active FROM v_change WHERE asset_key = 12 AND modified_at <= {AS_OF} HAVING count(*) > 0")
def graph_node_detail(spark, sf_dir):
    nodes, edges = _passive(spark, sf_dir)
    return load.node_detail(nodes, edges, "asset:12", as_of())[0].select("node_key", F.when(F.col("node_type") == "domain", "asset").otherwise(F.col("node_type")).alias("node_type"), "snapshots", "active")
