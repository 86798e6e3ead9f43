"""Registered queries over claims, revisions, relationships and indicators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import reconcile, revisions
from evistrata.operators.revisions import RevisionSpec
from evistrata.plans.bindings import AS_OF, AS_OF_SHIP, for_spark, sql, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def as_of(text: str = AS_OF):
    return F.expr(for_spark(text))


def registered(text: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


LATEST = "SELECT * FROM {v} QUALIFY row_number() OVER (PARTITION BY source_id, source_record_key ORDER BY modified_at DESC, snapshot_id DESC) = 1"
STATUS_OF_INCIDENT = """
    SELECT incident_key, arg_max(incident_type, CASE incident_type WHEN 'unknown' THEN 0 WHEN 'malware' THEN 1 WHEN 'data_breach' THEN 5 WHEN 'extortion' THEN 6 ELSE 7 END) AS incident_type,
        arg_max(title, (claim_type = 'official_confirmation', confidence, modified_at, snapshot_id)) AS title,
        CASE WHEN bool_or(positive AND claim_type = 'official_confirmation') THEN 'confirmed' WHEN bool_or(positive) AND bool_and(claim_type = 'attacker_allegation') FILTER (positive) THEN 'alleged'
             WHEN bool_or(positive) THEN 'reported' WHEN bool_or(active AND claim_type = 'denial') THEN 'denied' WHEN bool_or(active AND claim_type = 'retraction') THEN 'retracted' ELSE 'under_review' END AS status,
        CASE WHEN count(DISTINCT organization_id) FILTER (active AND link_status = 'exact') = 1 THEN max(organization_id) FILTER (active AND link_status = 'exact') END AS organization_id,
        CASE WHEN count(DISTINCT organization_id) FILTER (active AND link_status = 'exact') = 1 THEN 'exact' WHEN count(DISTINCT organization_id) FILTER (active AND link_status = 'exact') > 1 THEN 'review_required'
             ELSE arg_max(link_status, CASE link_status WHEN 'rejected' THEN 0 WHEN 'unresolved' THEN 1 WHEN 'candidate' THEN 2 ELSE 4 END) END AS organization_link_status,
        array_to_string(list_sort(list(DISTINCT organization_name)), ',') AS names, min(published_at) AS first_published_at, max(modified_at) AS last_updated_at, count(*) AS claim_count,
        count(DISTINCT independence_key) FILTER (positive) AS independent_source_count, bool_and(historical_only) AS historical_only
    FROM (SELECT *, active AND claim_type IN ('official_confirmation', 'report', 'attacker_allegation') AS positive FROM latest) GROUP BY incident_key"""


@registered(f"WITH latest AS ({LATEST.format(v='v_claim')}) {STATUS_OF_INCIDENT}")
def reconcile_incidents(spark, sf_dir):
    found = reconcile.reconcile_incidents(view(spark, sf_dir, "v_claim"))
    names = F.array_join("claimed_organization_names", ",").alias("names")
    return found.select("incident_key", "incident_type", "title", "status", "organization_id", "organization_link_status", names, "first_published_at", "last_updated_at", "claim_count", "independent_source_count", "historical_only")


@registered(f"WITH latest AS ({LATEST.format(v='v_claim')}) SELECT snapshot_id, source_id, source_record_key, modified_at FROM latest")
def revision_latest(spark, sf_dir):
    return revisions.latest_by(view(spark, sf_dir, "v_claim"), RevisionSpec()).select("snapshot_id", "source_id", "source_record_key", "modified_at")


GONE = "SELECT DISTINCT source_id, supersedes_record_key AS source_record_key FROM {of} WHERE supersedes_record_key IS NOT NULL"
EFFECTIVE = f"WITH latest AS ({LATEST.format(v='v_change')}), gone AS ({GONE.format(of='latest')}), kept AS (SELECT * FROM latest ANTI JOIN gone USING (source_id, source_record_key))"


@registered(f"{EFFECTIVE} SELECT snapshot_id, source_id, source_record_key FROM kept")
def revision_superseded(spark, sf_dir):
    return revisions.effective(view(spark, sf_dir, "v_change"), reconcile.CHANGES).select("snapshot_id", "source_id", "source_record_key")


FROM_ALL = f"""WITH latest AS ({LATEST.format(v='v_change')}), gone AS ({GONE.format(of='v_change')}), kept AS (SELECT * FROM latest ANTI JOIN gone USING (source_id, source_record_key)),
    full_ AS (SELECT * FROM kept UNION ALL SELECT * FROM (SELECT * FROM v_change ANTI JOIN kept USING (event_key) QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY modified_at DESC, snapshot_id DESC) = 1))"""


@registered(f"{FROM_ALL} SELECT snapshot_id, event_key FROM full_")
def revision_fallback(spark, sf_dir):
    spec = RevisionSpec(supersedes="supersedes_record_key", from_all=True, fallback="event_key")
    return revisions.effective(view(spark, sf_dir, "v_change"), spec).select("snapshot_id", "event_key")


SELF_FREE = f"""WITH latest AS ({LATEST.format(v='v_change')}), gone AS (SELECT DISTINCT source_id, supersedes_record_key AS source_record_key FROM latest WHERE supersedes_record_key <> source_record_key),
    kept AS (SELECT * FROM latest ANTI JOIN gone USING (source_id, source_record_key))"""


@registered(f"{SELF_FREE} SELECT snapshot_id, source_record_key FROM kept")
def revision_without_self(spark, sf_dir):
    return revisions.effective(view(spark, sf_dir, "v_change"), RevisionSpec(supersedes="supersedes_record_key", ignore_self=True)).select("snapshot_id", "source_record_key")


@registered("SELECT event_key AS key, arg_max(snapshot_id, (modified_at, confidence, snapshot_id)) AS snapshot_id FROM v_change GROUP BY ALL")
def revision_many_part_order(spark, sf_dir):
    spec = RevisionSpec(keys=("event_key",), order=("modified_at", "confidence"))
    return revisions.latest_by(view(spark, sf_dir, "v_change"), spec).select(F.col("event_key").alias("key"), "snapshot_id")


@registered("SELECT source_id, arg_max(snapshot_id, (modified_at, snapshot_id)) AS snapshot_id, incident_key FROM v_claim GROUP BY source_id, incident_key")
def revision_per_source(spark, sf_dir):
    return revisions.latest_by(view(spark, sf_dir, "v_claim"), RevisionSpec(keys=("incident_key", "source_id"))).select("source_id", "snapshot_id", "incident_key")


@registered("SELECT record_key, event_id, action, value FROM (SELECT * FROM v_raw WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY effective_at DESC, collected_at DESC, event_id DESC) = 1) WHERE action NOT IN ('tombstone', 'retraction')")
def revision_record_state(spark, sf_dir):
    return revisions.reduce_state(view(spark, sf_dir, "v_raw"), "record_key", ["effective_at", "collected_at", "event_id"], "action").select("record_key", "event_id", "action", "value")


@registered("SELECT snapshot_id, lag(source_record_key) OVER (PARTITION BY event_key ORDER BY modified_at, snapshot_id) AS previous_record_key FROM v_change")
def revision_previous(spark, sf_dir):
    return revisions.previous_revision(view(spark, sf_dir, "v_change"), "event_key", ["modified_at", "snapshot_id"], "source_record_key").select("snapshot_id", "previous_record_key")


CYCLES = """WITH RECURSIVE step AS (SELECT n AS a, (n * 7 + 3) % 400 AS b FROM (SELECT DISTINCT user_id AS n FROM events) WHERE n % 5 <> 0), walk AS (
    SELECT a AS origin, b AS seen FROM step UNION SELECT origin, b FROM walk JOIN step ON seen = a) SELECT DISTINCT origin AS record FROM walk WHERE origin = seen"""


@registered()
def revision_cycles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("record")).distinct().withColumn("supersedes", F.when(F.col("record") % 5 != 0, (F.col("record") * 7 + 3) % 400))
    return revisions.supersession_cycles(rows, "record", "supersedes")


ORACLE_SQL["revision_cycles"] = CYCLES

CHANGE_ROWS = f"""{EFFECTIVE}, marked AS (SELECT *, active AND claim_type IN ('official_announcement', 'report', 'speculation') AS positive, NOT coalesce(expires_at <= {AS_OF}, false) AS fresh FROM kept)
    SELECT event_key, arg_max(event_type, (claim_type = 'official_announcement', claim_type <> 'speculation', confidence, modified_at, snapshot_id)) AS event_type,
        CASE WHEN bool_or(positive AND claim_type = 'official_announcement' AND fresh) THEN 'confirmed' WHEN bool_or(active AND claim_type = 'dispute') AND bool_or(positive AND fresh) THEN 'disputed'
             WHEN bool_or(positive AND fresh) AND bool_and(claim_type = 'speculation') FILTER (positive AND fresh) THEN 'speculative' WHEN bool_or(positive AND fresh) THEN 'reported' WHEN bool_or(positive) THEN 'stale'
             WHEN bool_or(active AND claim_type = 'retraction') THEN 'retracted' WHEN bool_or(active AND claim_type = 'correction') THEN 'corrected' WHEN bool_or(active AND claim_type = 'dispute') THEN 'disputed' ELSE 'under_review' END AS status,
        count(*) AS claim_count, count(DISTINCT corroboration_key) FILTER (positive) AS independent_source_count, bool_or(active AND claim_type = 'dispute') AS has_dispute, bool_and(historical_only) AS historical_only
    FROM marked GROUP BY event_key"""


@registered(CHANGE_ROWS)
def reconcile_changes(spark, sf_dir):
    return reconcile.reconcile_changes(view(spark, sf_dir, "v_change"), as_of()).select("event_key", "event_type", "status", "claim_count", "independent_source_count", "has_dispute", "historical_only")


REL = f"""WITH latest AS ({LATEST.format(v='v_relationship')}), gone AS ({GONE.format(of='latest')}), kept AS (SELECT * FROM latest ANTI JOIN gone USING (source_id, source_record_key)),
    m AS (SELECT *, coalesce(expires_at <= {AS_OF_SHIP}, false) AS stale, historical_only OR evidence_class = 'historical' OR coalesce(valid_until <= {AS_OF_SHIP}, false) AS hist, active AND claim_type = 'assertion' AS said FROM kept),
    c AS (SELECT *, said AND NOT stale AND NOT hist AND coalesce(valid_from <= {AS_OF_SHIP}, true) AS cur, CASE evidence_class WHEN 'historical' THEN 0 WHEN 'inferred' THEN 1 WHEN 'claimed' THEN 2 WHEN 'observed' THEN 3 ELSE 4 END AS strength FROM m)"""


@registered(f"""{REL}
    SELECT relationship_key, CASE WHEN count(DISTINCT role) FILTER (said) > 1 THEN 'under_review' WHEN bool_or(active AND claim_type = 'dispute') AND bool_or(cur) THEN 'disputed' WHEN bool_or(cur AND evidence_class IN ('contracted', 'observed')) THEN 'active'
        WHEN bool_or(cur AND evidence_class = 'claimed') THEN 'claimed' WHEN bool_or(cur AND evidence_class = 'inferred') THEN 'inferred' WHEN bool_and(stale) FILTER (said) THEN 'stale' WHEN bool_and(hist) FILTER (said) THEN 'historical'
        WHEN bool_or(active AND claim_type = 'retraction') THEN 'retracted' WHEN bool_or(active AND claim_type = 'correction') THEN 'corrected' WHEN bool_or(active AND claim_type = 'dispute') THEN 'disputed' ELSE 'under_review' END AS status,
        arg_max(role, (claim_type = 'assertion', cur, strength, confidence, modified_at, snapshot_id)) AS role, count(*) AS evidence_count, count(DISTINCT coalesce(independence_key, source_id)) FILTER (said) AS independent_source_count,
        min(valid_from) FILTER (said) AS valid_from, max(valid_until) FILTER (said) AS valid_until, bool_or(cur AND evidence_class = 'contracted') AS has_contract_evidence,
        min(renewal_at) FILTER (cur AND evidence_class = 'contracted' AND renewal_at >= {AS_OF_SHIP}) AS next_renewal_at, bool_and(hist) AS historical_only
    FROM c GROUP BY relationship_key""")
def reconcile_relationships(spark, sf_dir):
    found = reconcile.reconcile_relationships(view(spark, sf_dir, "v_relationship"), as_of(AS_OF_SHIP), ("supplier",))
    return found.select("relationship_key", "status", "role", "evidence_count", "independent_source_count", "valid_from", "valid_until", "has_contract_evidence", "next_renewal_at", "historical_only")


@registered(f"""{REL}, ends AS (SELECT relationship_key,
        CASE WHEN count(DISTINCT source_organization_id) FILTER (active AND source_link_status = 'exact') = 1 THEN max(source_organization_id) FILTER (active AND source_link_status = 'exact') END AS s,
        CASE WHEN count(DISTINCT target_organization_id) FILTER (active AND target_link_status = 'exact') = 1 THEN max(target_organization_id) FILTER (active AND target_link_status = 'exact') END AS t FROM c GROUP BY 1)
    SELECT relationship_key, CASE WHEN s = t THEN NULL ELSE s END AS source_organization_id, CASE WHEN s = t THEN NULL ELSE t END AS target_organization_id FROM ends""")
def relationship_ends(spark, sf_dir):
    found = reconcile.reconcile_relationships(view(spark, sf_dir, "v_relationship"), as_of(AS_OF_SHIP))
    return found.select("relationship_key", "source_organization_id", "target_organization_id")


IND = f"WITH latest AS ({LATEST.format(v='v_indicator')})"


@registered(f"""{IND} SELECT indicator_key,
        arg_max(state, (source_precedence, modified_at, CASE state WHEN 'benign' THEN 90 WHEN 'malicious' THEN 70 WHEN 'suspicious' THEN 60 WHEN 'shared_infrastructure' THEN 50 ELSE 10 END, snapshot_id)) AS state,
        array_to_string(list_sort(list(DISTINCT state)), ',') AS states, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(DISTINCT source_id) AS source_count,
        count(DISTINCT independence_key) FILTER (active AND state IN ('malicious', 'suspicious')) AS independent_source_count, bool_or(active) AS active,
        count(DISTINCT state) FILTER (state IN ('malicious', 'suspicious', 'benign', 'retracted')) > 1 AS has_conflict
    FROM latest GROUP BY indicator_key""")
def reconcile_indicators(spark, sf_dir):
    found = reconcile.reconcile_indicators(view(spark, sf_dir, "v_indicator")).withColumn("states", F.array_join("observed_states", ","))
    return found.select("indicator_key", "state", "states", "first_seen_at", "last_seen_at", "source_count", "independent_source_count", "active", "has_conflict")


@registered(f"{IND} SELECT indicator_key, relation_type, target_key, max(relation_confidence) AS confidence FROM latest GROUP BY ALL")
def indicator_relations(spark, sf_dir):
    rows = view(spark, sf_dir, "v_indicator")
    relation = F.array(F.struct("relation_type", "target_key", F.col("relation_confidence").alias("confidence")))
    return reconcile.merge_relations(rows.withColumn("relations", relation))


LIVE = f"active AND coalesce(valid_from <= {AS_OF}, true) AND coalesce(valid_until > {AS_OF}, true)"


def _single(values: list[str]):
    shown = ", ".join(f"coalesce(arg_max({v}, (modified_at, snapshot_id)) FILTER ({LIVE}), arg_max({v}, (modified_at, snapshot_id))) AS {v}" for v in values)
    return f"""{FROM_ALL} SELECT event_key, {shown}, count(DISTINCT ({', '.join(f'lower({v})' for v in values)},)) FILTER ({LIVE}) > 1 AS has_conflict, count(*) FILTER ({LIVE}) AS live_claims,
        max(confidence) FILTER ({LIVE}) AS confidence, count(*) FILTER ({LIVE}) = 0 AS historical_only FROM full_ GROUP BY event_key"""


PROFESSIONAL = RevisionSpec(supersedes="supersedes_record_key", from_all=True, fallback="event_key")


@registered(_single(["event_type", "title"]))
def reconcile_roles(spark, sf_dir):
    return reconcile.reconcile_single_valued(view(spark, sf_dir, "v_change"), "event_key", ["event_type", "title"], as_of(), PROFESSIONAL)


@registered(_single(["corroboration_key"]))
def reconcile_contacts(spark, sf_dir):
    return reconcile.reconcile_single_valued(view(spark, sf_dir, "v_change"), "event_key", ["corroboration_key"], as_of(), PROFESSIONAL)


@registered(f"""{SELF_FREE}, f AS (SELECT v.*, k.snapshot_id IS NOT NULL AS eff, k.snapshot_id IS NOT NULL AND v.active AND NOT coalesce(v.expires_at <= {AS_OF}, false) AS live
        FROM v_change v LEFT JOIN kept k ON k.snapshot_id = v.snapshot_id)
    SELECT asset_key, count(*) AS history_count, count(*) FILTER (eff) AS effective_count, count(*) FILTER (live) AS active_count, min(published_at) AS first_seen_at, max(modified_at) FILTER (eff) AS last_updated_at,
        CASE WHEN count(DISTINCT organization_id) FILTER (live AND link_status = 'exact') = 1 AND count(DISTINCT organization_id) FILTER (live) = 1 AND NOT bool_or(live AND attribution_risk) THEN 'exact'
             WHEN count(DISTINCT organization_id) FILTER (live) > 0 THEN 'review_required' ELSE 'unresolved' END AS organization_link_status
    FROM f GROUP BY asset_key""")
def reconcile_assets(spark, sf_dir):
    spec = RevisionSpec(supersedes="supersedes_record_key", ignore_self=True)
    found = reconcile.reconcile_assets(view(spark, sf_dir, "v_change"), as_of(), spec)
    return found.select("asset_key", "history_count", "effective_count", "active_count", "first_seen_at", "last_updated_at", "organization_link_status")
