"""Registered queries over vulnerabilities, pages of every family and details of single entities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.operators import applicability, listing, reconcile, vulnerabilities
from evistrata.plans import decisions, evidence
from evistrata.plans.bindings import AS_OF, AS_OF_SHIP, sql, table, view
from evistrata.plans.evidence import as_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


def _of(name: str, part=evidence) -> str:
    """The SQL of another query as a table."""
    return f"({part.ORACLE_SQL[name]})"


# ---- vulnerabilities

GROUPED = """WITH RECURSIVE latest AS (SELECT * FROM v_vulnerability QUALIFY row_number() OVER (PARTITION BY source, source_record_key ORDER BY modified_at DESC, snapshot_id DESC) = 1),
    named AS (SELECT snapshot_id, canonical_id AS i FROM latest UNION SELECT snapshot_id, alias FROM latest WHERE alias IS NOT NULL),
    sides AS (SELECT 's' || snapshot_id AS a, 'i' || i AS b FROM named UNION SELECT 'i' || i, 's' || snapshot_id FROM named), reach AS (SELECT a AS node, a AS seen FROM sides UNION SELECT node, b FROM reach JOIN sides ON seen = a),
    comp AS (SELECT cast(substr(node, 2) AS bigint) AS snapshot_id, min(seen) AS component FROM reach WHERE node LIKE 's%' GROUP BY node),
    g AS (SELECT l.*, component FROM latest l JOIN comp USING (snapshot_id)),
    ids AS (SELECT component, list_sort(list(DISTINCT i)) AS ids FROM named JOIN comp USING (snapshot_id) GROUP BY 1),
    names AS (SELECT component, ids, coalesce(list_filter(ids, lambda x: x LIKE 'CVE-%')[1], ids[1]) AS canonical_id FROM ids)"""
_ORDER = "(source_precedence, -epoch_us(modified_at), snapshot_id)"
RECONCILED = f"""r AS (SELECT canonical_id, array_to_string(list_filter(any_value(ids), lambda x: x <> n.canonical_id), ',') AS aliases, arg_min(title, {_ORDER}) FILTER (trim(title) <> '') AS title, arg_min(description, {_ORDER}) FILTER (trim(description) <> '') AS description,
        arg_max(status, CASE status WHEN 'rejected' THEN 5 WHEN 'withdrawn' THEN 4 WHEN 'updated' THEN 2 ELSE 1 END) AS status, min(published_at) AS published_at, max(modified_at) AS modified_at, count(DISTINCT source) AS source_count, array_to_string(list_sort(list(DISTINCT cwe)), ',') AS cwes
    FROM (SELECT component, snapshot_id, source, source_precedence, title, description, status, published_at, modified_at, cwe FROM g) JOIN names n USING (component) GROUP BY canonical_id)"""


def snapshots(spark, sf_dir) -> DataFrame:
    v = view(spark, sf_dir, "v_vulnerability")
    none = F.lit(None)
    return v.select(
        "snapshot_id", "source", "source_record_key", "source_precedence", "canonical_id", F.array_compact(F.array("alias")).alias("aliases"), "title", "description", "status", "published_at", "modified_at", F.array("cwe").alias("cwes"),
        F.array(F.struct(F.col("score_system").alias("system"), F.col("score_value").alias("value"), none.cast("string").alias("vector"), none.cast("double").alias("percentile"), "assessed_at")).alias("scores"),
        F.array(F.struct("ecosystem", "product", "introduced", "fixed", none.cast("string").alias("last_affected"), F.lit("range").alias("precision"))).alias("ranges"),
        F.array(F.struct("kind", F.col("kind_active").alias("active"), F.col("published_at").alias("first_seen_at"), F.col("modified_at").alias("last_seen_at"), none.cast("timestamp_ntz").alias("due_date"), F.col("kind_confidence").alias("confidence"))).alias("exploitation"),
        none.cast("string").alias("superseded_by"),
    )


def grouped(spark, sf_dir) -> DataFrame:
    return vulnerabilities.grouped(vulnerabilities.latest(snapshots(spark, sf_dir)))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("canonical_id", F.array_join("aliases", ",").alias("aliases"), "title", "description", "status", "published_at", "modified_at", "source_count", F.array_join("cwes", ",").alias("cwes"))


@registered(f"{GROUPED}, {RECONCILED} SELECT * FROM r")
def reconcile_vulnerabilities(spark, sf_dir):
    return _flat(vulnerabilities.reconcile(grouped(spark, sf_dir)))


@registered(f"{GROUPED} SELECT canonical_id, score_system AS system, score_value AS value, assessed_at FROM (SELECT DISTINCT component, score_system, score_value, assessed_at FROM g) JOIN names USING (component)")
def vulnerability_scores(spark, sf_dir):
    rows = grouped(spark, sf_dir)
    return vulnerabilities.scores(rows).join(vulnerabilities.reconcile(rows).select("component", "canonical_id"), "component").select("canonical_id", "system", "value", "assessed_at")


@registered(f"{GROUPED} SELECT component, arg_max(ecosystem, snapshot_id) AS ecosystem, arg_max(product, snapshot_id) AS product, introduced, fixed FROM g GROUP BY component, lower(ecosystem), lower(product), introduced, fixed")
def vulnerability_ranges(spark, sf_dir):
    return vulnerabilities.ranges(grouped(spark, sf_dir)).select("component", "ecosystem", "product", "introduced", "fixed")


@registered(f"{GROUPED} SELECT component, kind, bool_or(kind_active) AS active, min(published_at) AS first_seen_at, max(modified_at) AS last_seen_at, max(kind_confidence) AS confidence FROM g GROUP BY component, kind")
def vulnerability_exploitation(spark, sf_dir):
    return vulnerabilities.exploitation(grouped(spark, sf_dir)).select("component", "kind", "active", "first_seen_at", "last_seen_at", "confidence")


SUMMARY = """summary AS (SELECT component, max(score_value) FILTER (score_system LIKE 'cvss_%') AS maximum_cvss, arg_max(score_value, (assessed_at, score_value)) FILTER (score_system = 'epss') AS latest_epss,
    coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind_active)), ','), '') AS kinds FROM g GROUP BY component)"""


@registered(f"{GROUPED}, {SUMMARY} SELECT canonical_id, maximum_cvss, latest_epss, kinds FROM summary JOIN names USING (component)")
def vulnerability_summaries(spark, sf_dir):
    return vulnerabilities.summaries(grouped(spark, sf_dir)).select("canonical_id", "maximum_cvss", "latest_epss", F.array_join("exploitation_kinds", ",").alias("kinds"))


@registered(f"{GROUPED}, {RECONCILED} SELECT canonical_id, aliases, status, source_count FROM r JOIN names USING (canonical_id) WHERE list_contains(ids, 'GHSA-12')")
def vulnerability_detail(spark, sf_dir):
    return _flat(vulnerabilities.by_identifier(vulnerabilities.reconcile(grouped(spark, sf_dir)), " ghsa-12 ")).select("canonical_id", "aliases", "status", "source_count")


@registered("""WITH k AS (SELECT DISTINCT canonical_id AS owner, canonical_id AS i FROM v_vulnerability), n AS (SELECT snapshot_id, canonical_id AS i FROM v_vulnerability UNION SELECT snapshot_id, alias FROM v_vulnerability WHERE alias IS NOT NULL)
    SELECT snapshot_id, count(DISTINCT owner) AS records FROM n JOIN k USING (i) GROUP BY 1 HAVING count(DISTINCT owner) > 1""")
def vulnerability_alias_conflicts(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    known = rows.select("canonical_id").distinct().withColumn("aliases", F.array().cast("array<string>"))
    return vulnerabilities.joined_records(known, rows)


# ---- pages: filters, children that must exist, order, one page

_Q = lambda cols, q: "(" + " OR ".join(f"coalesce({c}::varchar ILIKE '%{q}%', false)" for c in cols) + ")"


def _order(spec: listing.Listing) -> str:
    return ", ".join(f"{c[1:]} DESC NULLS LAST" if c.startswith("-") else f"{c} NULLS LAST" for c in spec.order)


@registered(f"""SELECT incident_key, status, title FROM {_of('reconcile_incidents')} i WHERE status IN ('reported', 'alleged') AND {_Q(('title', 'names'), 'org 1')} AND EXISTS (SELECT 1 FROM v_claim c WHERE c.incident_key = i.incident_key AND c.source_id = 's1')
    ORDER BY {_order(listing.INCIDENTS)} LIMIT 50 OFFSET 10""")
def list_incidents(spark, sf_dir):
    claims = view(spark, sf_dir, "v_claim").filter("source_id = 's1'")
    rows = evidence.reconcile_incidents(spark, sf_dir)
    spec = listing.Listing(listing.INCIDENTS.order, ("title", "names"))
    return listing.page(listing.selected(rows, spec, F.col("status").isin("reported", "alleged"), "org 1", [(claims, "incident_key")]), spec, 50, 10).select("incident_key", "status", "title")


@registered(f"SELECT count(*) AS total FROM {_of('reconcile_incidents')} i WHERE status = 'reported' AND EXISTS (SELECT 1 FROM v_claim c WHERE c.incident_key = i.incident_key AND c.source_id = 's2')")
def count_incidents(spark, sf_dir):
    claims = view(spark, sf_dir, "v_claim").filter("source_id = 's2'")
    return listing.selected(evidence.reconcile_incidents(spark, sf_dir), listing.INCIDENTS, F.col("status") == "reported", exists=[(claims, "incident_key")]).agg(F.count("*").alias("total"))


@registered(f"""SELECT event_key, status, event_type FROM {_of('reconcile_changes')} i WHERE NOT has_dispute AND {_Q(('event_type',), 'IC')} AND EXISTS (SELECT 1 FROM v_change c WHERE c.event_key = i.event_key AND c.organization_id = 3)
    ORDER BY claim_count DESC, event_key LIMIT 40""")
def list_change_events(spark, sf_dir):
    claims = view(spark, sf_dir, "v_change").filter("organization_id = 3")
    spec = listing.Listing(("-claim_count", "event_key"), ("event_type",))
    return listing.page(listing.selected(evidence.reconcile_changes(spark, sf_dir), spec, ~F.col("has_dispute"), "IC", [(claims, "event_key")]), spec, 40).select("event_key", "status", "event_type")


@registered(f"""SELECT r.relationship_key, status, role FROM {_of('reconcile_relationships')} r JOIN {_of('relationship_ends')} e USING (relationship_key) WHERE (source_organization_id = 3 OR target_organization_id = 3) AND status <> 'disputed'
    ORDER BY evidence_count DESC, relationship_key LIMIT 50 OFFSET 5""")
def list_relationships(spark, sf_dir):
    rows = reconcile.reconcile_relationships(view(spark, sf_dir, "v_relationship"), as_of(AS_OF_SHIP), ("supplier",))  # statuses and ends of one reconciliation
    spec = listing.Listing(("-evidence_count", "relationship_key"))
    where = ((F.col("source_organization_id") == 3) | (F.col("target_organization_id") == 3)) & (F.col("status") != "disputed")
    return listing.page(listing.selected(rows, spec, where), spec, 50, 5).select("relationship_key", "status", "role")


@registered(f"""SELECT indicator_key, state FROM {_of('reconcile_indicators')} i WHERE active AND EXISTS (SELECT 1 FROM v_indicator x WHERE x.indicator_key = i.indicator_key AND source_id = 's1') AND EXISTS (SELECT 1 FROM v_indicator x WHERE x.indicator_key = i.indicator_key AND relation_type = 't0')
    ORDER BY {_order(listing.INDICATORS)} LIMIT 60""")
def list_threat_indicators(spark, sf_dir):
    """Two children that need not be the same."""
    v = view(spark, sf_dir, "v_indicator")
    found = listing.selected(evidence.reconcile_indicators(spark, sf_dir), listing.INDICATORS, F.col("active"), None, [(v.filter("source_id = 's1'"), "indicator_key"), (v.filter("relation_type = 't0'"), "indicator_key")])
    return listing.page(found, listing.INDICATORS, 60).select("indicator_key", "state")


@registered(f"""SELECT asset_key, active_count FROM {_of('reconcile_assets')} a JOIN (SELECT asset_key, list(DISTINCT organization_id) AS candidates FROM v_change WHERE organization_id IS NOT NULL GROUP BY 1) USING (asset_key) WHERE list_contains(candidates, 2) ORDER BY {_order(listing.ASSETS)} LIMIT 45""")
def list_passive_assets(spark, sf_dir):
    candidates = view(spark, sf_dir, "v_change").filter("organization_id is not null").groupBy("asset_key").agg(F.collect_set("organization_id").alias("candidates"))
    rows = evidence.reconcile_assets(spark, sf_dir).join(candidates, "asset_key")
    return listing.page(listing.selected(rows, listing.ASSETS, F.array_contains("candidates", 2)), listing.ASSETS, 45).select("asset_key", "active_count")


@registered(f"""{GROUPED}, {RECONCILED} SELECT r.canonical_id, r.status FROM r JOIN names n USING (canonical_id) WHERE {_Q(('canonical_id', 'r.title', 'r.description'), '1')} AND EXISTS (SELECT 1 FROM g WHERE g.component = n.component AND source = 's1')
    AND EXISTS (SELECT 1 FROM g WHERE g.component = n.component AND kind_active) ORDER BY modified_at DESC, canonical_id LIMIT 50""")
def list_vulnerabilities(spark, sf_dir):
    rows = grouped(spark, sf_dir)
    active = rows.filter(F.exists("exploitation", lambda x: x["active"]))
    found = listing.selected(vulnerabilities.reconcile(rows), listing.VULNERABILITIES, None, "1", [(rows.filter("source = 's1'"), "component"), (active, "component")])
    return listing.page(found, listing.VULNERABILITIES, 50).select("canonical_id", "status")


@registered(f"""SELECT technology_id, vulnerability_id, state, scheme FROM {_of('assess_applicability', decisions)} a JOIN v_technology t USING (technology_id) LEFT JOIN (SELECT range_id, scheme FROM v_range) r ON r.range_id = matched_range
    WHERE {_Q(('vendor', 'product', 'version', 'state', 'scheme'), 'p3')} ORDER BY a.confidence DESC, technology_id, vulnerability_id LIMIT 70""")
def list_applicability_assessments(spark, sf_dir):
    rows = applicability.assess(view(spark, sf_dir, "v_technology"), view(spark, sf_dir, "v_range"), keep=("vendor", "product", "version"), told=("scheme",))
    spec = listing.Listing(listing.APPLICABILITY.order, ("vendor", "product", "version", "state", "scheme"))
    return listing.page(listing.selected(rows, spec, None, "p3"), spec, 70).select("technology_id", "vulnerability_id", "state", "scheme")


@registered(f"""SELECT organization_id, score, best FROM {_of('buying_intent', decisions)} o JOIN (SELECT organization_id, max(confidence) AS best FROM {_of('fuse_hypotheses', decisions)} WHERE family IN ('siem', 'soc') GROUP BY 1) USING (organization_id)
    WHERE score >= 20 AND data_quality IN ('complete', 'partial') ORDER BY score DESC, last_evidence_at DESC, organization_id LIMIT 25""")
def list_opportunities(spark, sf_dir):
    best = decisions.fuse_hypotheses(spark, sf_dir).filter(F.col("family").isin("siem", "soc")).groupBy("organization_id").agg(F.max("confidence").alias("best"))
    rows = decisions.buying_intent(spark, sf_dir).join(best, "organization_id")
    where = (F.col("score") >= 20) & F.col("data_quality").isin("complete", "partial")
    return listing.page(listing.selected(rows, listing.OPPORTUNITIES, where), listing.OPPORTUNITIES, 25).select("organization_id", "score", "best")


@registered(f"""SELECT organization_id, requested_class, family, confidence FROM {_of('fuse_hypotheses', decisions)} WHERE family = 'siem' AND confidence >= 0.2 ORDER BY {_order(listing.HYPOTHESES)} LIMIT 30""")
def list_need_hypotheses(spark, sf_dir):
    """The family is sought before the page is cut."""
    found = listing.selected(decisions.fuse_hypotheses(spark, sf_dir), listing.HYPOTHESES, (F.col("family") == "siem") & (F.col("confidence") >= 0.2))
    return listing.page(found, listing.HYPOTHESES, 30).select("organization_id", "requested_class", "family", "confidence")


@registered(f"""SELECT node_key, display_name FROM {_of('reconcile_nodes', decisions)} WHERE current AND {_Q(('display_name',), 'change 1')} ORDER BY {_order(listing.NODES)} LIMIT 35 OFFSET 3""")
def list_graph_nodes(spark, sf_dir):
    return listing.page(listing.selected(decisions.reconcile_nodes(spark, sf_dir), listing.NODES, F.col("current"), "change 1"), listing.Listing(listing.NODES.order), 35, 3).select("node_key", "display_name")


PEOPLE = f"""SELECT person_key, arg_max(display_name, (observed_at, snapshot_id)) AS display_name, arg_max(suppressed, (observed_at, snapshot_id)) AS suppressed, arg_max(deleted, (observed_at, snapshot_id)) AS deleted,
    max(observed_at) AS last_observed_at, count(*) AS references_, NOT arg_max(suppressed, (observed_at, snapshot_id)) AND NOT arg_max(deleted, (observed_at, snapshot_id)) AND arg_max(retention_until, (observed_at, snapshot_id)) > {AS_OF} AS current FROM v_person GROUP BY person_key"""


def people(spark, sf_dir):
    from evistrata.operators.professional import reconcile_persons

    return reconcile_persons(view(spark, sf_dir, "v_person"), as_of())


@registered(f"SELECT person_key, display_name, current, last_observed_at, references_ AS mentions FROM ({PEOPLE})")
def reconcile_persons(spark, sf_dir):
    return people(spark, sf_dir).select("person_key", "display_name", "current", "last_observed_at", F.col("references").alias("mentions"))


ROLE = f"(SELECT 'p' || (event_key % 200) AS person_key, event_type, title FROM {_of('reconcile_roles')})"


@registered(f"""SELECT person_key, display_name FROM ({PEOPLE}) p WHERE NOT suppressed AND NOT deleted AND EXISTS (SELECT 1 FROM {ROLE} r WHERE r.person_key = p.person_key AND event_type = 'view')
    AND (display_name ILIKE '%name 1%' OR EXISTS (SELECT 1 FROM {ROLE} r WHERE r.person_key = p.person_key AND title ILIKE '%change 5%')) ORDER BY {_order(listing.PEOPLE)} LIMIT 40""")
def list_professional_people(spark, sf_dir):
    """A name OR the title of a role: the second existence is joined as a mark."""
    roles = evidence.reconcile_roles(spark, sf_dir).withColumn("person_key", F.concat(F.lit("p"), (F.col("event_key") % 200).cast("string")))
    titled = roles.filter(F.col("title").ilike("%change 5%")).select("person_key").distinct().withColumn("titled", F.lit(True))
    rows = people(spark, sf_dir).join(titled, "person_key", "left")
    where = ~F.col("suppressed") & ~F.col("deleted") & (F.col("display_name").ilike("%name 1%") | F.coalesce("titled", F.lit(False)))
    return listing.page(listing.selected(rows, listing.PEOPLE, where, exists=[(roles.filter("event_type = 'view'"), "person_key")]), listing.PEOPLE, 40).select("person_key", "display_name")


@registered("SELECT c_custkey AS source_id, c_mktsegment AS state FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30 OFFSET 20")
def list_approvals(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("updated_at"))
    return listing.page(listing.selected(rows, listing.APPROVALS, F.col("updated_at") > 0), listing.APPROVALS, 30, 20).select("source_id", "state")


@registered("SELECT o_orderkey AS plan_id, o_orderstatus AS state FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def list_research_plans(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("updated_at"))
    return listing.page(rows, listing.PLANS, 25, 5).select("plan_id", "state")


# ---- details: one entity with its children; list items: all entities with what their children tell


def _shown(found: DataFrame, key: str, fields: list[str], **parts: str) -> DataFrame:
    """Children as joined texts, so that an engine without arrays of structs can compare them."""
    texts = [F.array_join(F.col(f"{name}.{c}").cast("array<string>"), ",").alias(name) for name, c in parts.items()]
    return found.select(key, *fields, *texts, *[F.col(f"n_{n}").cast("long").alias(f"n_{n}") for n in parts])


@registered(f"""SELECT incident_key, status, names, (SELECT string_agg(snapshot_id::varchar, ',' ORDER BY modified_at DESC, snapshot_id DESC) FROM v_claim c WHERE c.incident_key = i.incident_key) AS claims, (SELECT count(*) FROM v_claim c WHERE c.incident_key = i.incident_key) AS n_claims FROM {_of('reconcile_incidents')} i WHERE incident_key = 7""")
def incident_detail(spark, sf_dir):
    found = listing.detail(evidence.reconcile_incidents(spark, sf_dir), "incident_key", 7, {"claims": (view(spark, sf_dir, "v_claim"), ["snapshot_id"], ["modified_at", "snapshot_id"], True)})
    return _shown(found, "incident_key", ["status", "names"], claims="snapshot_id")


def _child(v: str, key: str, of: str, order: str, where: str = "true") -> str:
    return f"(SELECT string_agg({of}::varchar, ',' ORDER BY {order}) FROM {v} c WHERE c.{key} = i.{key} AND {where})"


@registered(f"""SELECT event_key, status, {_child('v_change', 'event_key', 'snapshot_id', 'modified_at DESC, snapshot_id DESC')} AS claims, (SELECT count(*) FROM v_change c WHERE c.event_key = i.event_key) AS n_claims,
    {_child('v_change', 'event_key', 'event_type', 'event_type, snapshot_id')} AS mappings, (SELECT count(*) FROM v_change c WHERE c.event_key = i.event_key) AS n_mappings FROM {_of('reconcile_changes')} i WHERE event_key = 11""")
def change_detail(spark, sf_dir):
    v = view(spark, sf_dir, "v_change")
    parts = {"claims": (v, ["snapshot_id"], ["modified_at", "snapshot_id"], True), "mappings": (v, ["event_type"], ["event_type", "snapshot_id"], False)}
    return _shown(listing.detail(evidence.reconcile_changes(spark, sf_dir), "event_key", 11, parts), "event_key", ["status"], claims="snapshot_id", mappings="event_type")


@registered(f"""SELECT relationship_key, status, {_child('v_relationship', 'relationship_key', 'snapshot_id', 'modified_at DESC, snapshot_id DESC')} AS evidence,
    (SELECT count(*) FROM v_relationship c WHERE c.relationship_key = i.relationship_key) AS n_evidence FROM {_of('reconcile_relationships')} i WHERE relationship_key = '1>1'""")
def relationship_detail(spark, sf_dir):
    found = listing.detail(evidence.reconcile_relationships(spark, sf_dir), "relationship_key", "1>1", {"evidence": (view(spark, sf_dir, "v_relationship"), ["snapshot_id"], ["modified_at", "snapshot_id"], True)})
    return _shown(found, "relationship_key", ["status"], evidence="snapshot_id")


@registered(f"""SELECT indicator_key, state, {_child('v_indicator', 'indicator_key', 'snapshot_id', 'modified_at DESC, snapshot_id DESC')} AS snapshots, (SELECT count(*) FROM v_indicator c WHERE c.indicator_key = i.indicator_key) AS n_snapshots,
    (SELECT string_agg(target_key, ',' ORDER BY relation_type, target_key) FROM {_of('indicator_relations')} c WHERE c.indicator_key = i.indicator_key) AS relations, (SELECT count(*) FROM {_of('indicator_relations')} c WHERE c.indicator_key = i.indicator_key) AS n_relations
    FROM {_of('reconcile_indicators')} i WHERE indicator_key = 5""")
def indicator_detail(spark, sf_dir):
    parts = {"snapshots": (view(spark, sf_dir, "v_indicator"), ["snapshot_id"], ["modified_at", "snapshot_id"], True), "relations": (evidence.indicator_relations(spark, sf_dir), ["target_key"], ["relation_type", "target_key"], False)}
    return _shown(listing.detail(evidence.reconcile_indicators(spark, sf_dir), "indicator_key", 5, parts), "indicator_key", ["state"], snapshots="snapshot_id", relations="target_key")


@registered(f"""SELECT asset_key, active_count, {_child('v_change', 'asset_key', 'title', 'modified_at DESC, snapshot_id DESC')} AS technologies, (SELECT count(*) FROM v_change c WHERE c.asset_key = i.asset_key) AS n_technologies FROM {_of('reconcile_assets')} i WHERE asset_key = 9""")
def asset_detail(spark, sf_dir):
    found = listing.detail(evidence.reconcile_assets(spark, sf_dir), "asset_key", 9, {"technologies": (view(spark, sf_dir, "v_change"), ["title"], ["modified_at", "snapshot_id"], True)})
    return _shown(found, "asset_key", ["active_count"], technologies="title")


@registered(f"""SELECT technology_id, vulnerability_id, state, (SELECT string_agg(range_id::varchar, ',' ORDER BY range_id) FROM v_range r JOIN v_technology t USING (vendor, product) WHERE t.technology_id = a.technology_id AND r.vulnerability_id = a.vulnerability_id) AS ranges
    FROM {_of('assess_applicability', decisions)} a WHERE technology_id = 42""")
def applicability_detail(spark, sf_dir):
    mine = view(spark, sf_dir, "v_technology").filter("technology_id = 42")
    product = F.broadcast(mine.select("technology_id", "vendor", "product"))  # one row
    ranges = view(spark, sf_dir, "v_range").join(product.select("vendor", "product"), ["vendor", "product"], "left_semi")
    met = ranges.join(product, ["vendor", "product"]).groupBy("technology_id", "vulnerability_id").agg(F.array_sort(F.collect_list("range_id")).alias("r"))
    rows = applicability.assess(mine, ranges).join(met, ["technology_id", "vulnerability_id"], "left")
    return rows.select("technology_id", "vulnerability_id", "state", F.array_join(F.col("r").cast("array<string>"), ",").alias("ranges"))


@registered("""SELECT contract_id, buyer_name, (SELECT string_agg(l_suppkey::varchar, ',' ORDER BY l_linenumber, l_suppkey) FROM lineitem WHERE l_orderkey = contract_id) AS parties, (SELECT count(*) FROM lineitem WHERE l_orderkey = contract_id) AS n_parties FROM v_contract WHERE contract_id = 100""")
def contract_detail(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "contract_id")
    found = listing.detail(view(spark, sf_dir, "v_contract"), "contract_id", 100, {"parties": (items, ["l_suppkey"], ["l_linenumber", "l_suppkey"], False)})
    return _shown(found, "contract_id", ["buyer_name"], parties="l_suppkey")


RESOURCE = "(SELECT event_id, user_id % 300 AS resource_id, 'h' || (event_id % 9) AS content_hash, ts, event_type FROM events)"


def _sightings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 300).alias("resource_id"), F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("content_hash"), "ts", "event_type")


@registered(f"SELECT resource_id, string_agg(event_id::varchar, ',' ORDER BY ts DESC, event_id DESC) AS versions, count(*) AS n_versions FROM {RESOURCE} WHERE resource_id = 17 GROUP BY 1")
def resource_detail(spark, sf_dir):
    v = _sightings(spark, sf_dir)
    return _shown(listing.detail(v.select("resource_id").distinct(), "resource_id", 17, {"versions": (v, ["event_id"], ["ts", "event_id"], True)}), "resource_id", [], versions="event_id")


@registered(f"SELECT resource_id, arg_max(content_hash, (ts, event_id)) AS latest, count(DISTINCT content_hash) AS versions, count(*) FILTER (event_type = 'click') AS claims FROM {RESOURCE} GROUP BY 1")
def resource_items(spark, sf_dir):
    v = _sightings(spark, sf_dir)
    parts = {"latest": (v, F.max_by("content_hash", F.struct("ts", "event_id"))), "versions": (v, F.count_distinct("content_hash")), "claims": (v, F.count_if(F.col("event_type") == "click"))}
    return listing.with_counts(v.select("resource_id").distinct(), "resource_id", parts)


@registered(f"""SELECT organization_id, score, (SELECT max(confidence) FROM {_of('fuse_hypotheses', decisions)} h WHERE h.organization_id = o.organization_id) AS best, (SELECT count(DISTINCT evidence_id) FROM v_signal s WHERE s.organization_id = o.organization_id) AS evidence FROM {_of('buying_intent', decisions)} o""")
def opportunity_items(spark, sf_dir):
    parts = {"best": (decisions.fuse_hypotheses(spark, sf_dir), F.max("confidence")), "evidence": (view(spark, sf_dir, "v_signal"), F.count_distinct("evidence_id"))}
    return listing.with_counts(decisions.buying_intent(spark, sf_dir).select("organization_id", "score"), "organization_id", parts)


@registered(f"""SELECT organization_id, score, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence FROM {_of('buying_intent', decisions)} JOIN v_signal USING (organization_id) WHERE organization_id = 12 AND signal_type = 'public_tender' GROUP BY ALL""")
def opportunity_detail(spark, sf_dir):
    """Evidence through the signals that link to it."""
    linked = view(spark, sf_dir, "v_signal").filter("organization_id = 12 and signal_type = 'public_tender'").groupBy("organization_id").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("evidence"))
    return decisions.buying_intent(spark, sf_dir).filter("organization_id = 12").join(linked, "organization_id").select("organization_id", "score", "evidence")


@registered("""SELECT contract_id, buyer_name, providers, families FROM v_contract LEFT JOIN (SELECT l_orderkey AS contract_id, string_agg(DISTINCT l_suppkey::varchar, ',' ORDER BY l_suppkey::varchar) AS providers, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS families FROM lineitem GROUP BY 1) USING (contract_id)""")
def contract_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_suppkey").cast("string").alias("s"), "l_returnflag")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = items.groupBy("contract_id").agg(joined("s").alias("providers"), joined("l_returnflag").alias("families"))
    return view(spark, sf_dir, "v_contract").join(per, "contract_id", "left").select("contract_id", "buyer_name", "providers", "families")


ROLES_OF = f"(SELECT 'p' || (event_key % 200) AS person_key, event_key, title, live_claims FROM {_of('reconcile_roles')})"


def _roles(spark, sf_dir):
    return evidence.reconcile_roles(spark, sf_dir).withColumn("person_key", F.concat(F.lit("p"), (F.col("event_key") % 200).cast("string")))


@registered(f"SELECT person_key, display_name, (SELECT arg_max(title, event_key) FROM {ROLES_OF} r WHERE r.person_key = p.person_key AND live_claims > 0) AS newest_role FROM ({PEOPLE}) p")
def person_items(spark, sf_dir):
    live = _roles(spark, sf_dir).filter("live_claims > 0")
    return listing.with_counts(people(spark, sf_dir).select("person_key", "display_name"), "person_key", {"newest_role": (live, F.max_by("title", "event_key"))})


@registered(f"""SELECT person_key, display_name, {_child(ROLES_OF, 'person_key', 'event_key', 'event_key')} AS roles, (SELECT count(*) FROM {ROLES_OF} c WHERE c.person_key = i.person_key) AS n_roles,
    {_child('v_person', 'person_key', 'snapshot_id', 'observed_at DESC, snapshot_id DESC')} AS mentions, (SELECT count(*) FROM v_person c WHERE c.person_key = i.person_key) AS n_mentions FROM ({PEOPLE}) i WHERE person_key = 'p21'""")
def person_detail(spark, sf_dir):
    parts = {"roles": (_roles(spark, sf_dir), ["event_key"], ["event_key"], False), "mentions": (view(spark, sf_dir, "v_person"), ["snapshot_id"], ["observed_at", "snapshot_id"], True)}
    return _shown(listing.detail(people(spark, sf_dir), "person_key", "p21", parts), "person_key", ["display_name"], roles="event_key", mentions="snapshot_id")


@registered(f"""WITH m AS (SELECT DISTINCT 'p' || (event_key % 200) AS person_key, organization_id FROM v_change WHERE organization_id IS NOT NULL) SELECT organization_id, count(*) AS people, count(*) FILTER (current) AS current_people FROM m JOIN ({PEOPLE}) USING (person_key) GROUP BY 1""")
def organization_people(spark, sf_dir):
    m = view(spark, sf_dir, "v_change").filter("organization_id is not null").select(F.concat(F.lit("p"), (F.col("event_key") % 200).cast("string")).alias("person_key"), "organization_id").distinct()
    return m.join(people(spark, sf_dir), "person_key").groupBy("organization_id").agg(F.count("*").alias("people"), F.count_if("current").alias("current_people"))


@registered("SELECT postal_code AS organization_id, string_agg(identity_id::varchar, ',' ORDER BY name, identity_id) AS identities, count(*) AS n_identities FROM v_identity WHERE postal_code = 3 GROUP BY 1")
def organization_identities(spark, sf_dir):
    v = view(spark, sf_dir, "v_identity").withColumnRenamed("postal_code", "organization_id")
    return _shown(listing.detail(v.select("organization_id").distinct(), "organization_id", 3, {"identities": (v, ["identity_id"], ["name", "identity_id"], False)}), "organization_id", [], identities="identity_id")

