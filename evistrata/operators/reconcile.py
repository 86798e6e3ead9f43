"""Reconciliation: one row per entity from the statements that count, at an explicit time.

Every function is one aggregation by the entity's key followed by column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.operators.revisions import RevisionSpec, effective, latest_by

# The strength of incident types, link states, evidence classes and indicator states.
INCIDENT_TYPES = {"unknown": 0, "malware": 1, "service_disruption": 2, "unauthorized_access": 3, "business_email_compromise": 4, "data_breach": 5, "extortion": 6, "ransomware": 7, "supply_chain": 8}
LINK_STATES = {"rejected": 0, "unresolved": 1, "candidate": 2, "review_required": 3, "exact": 4}
EVIDENCE_CLASSES = {"historical": 0, "inferred": 1, "claimed": 2, "observed": 3, "contracted": 4}
INDICATOR_STATES = {"benign": 90, "retracted": 85, "sinkholed": 80, "malicious": 70, "suspicious": 60, "shared_infrastructure": 50, "historical": 40, "expired": 30, "unknown": 10}
CONFLICTING_STATES = ("malicious", "suspicious", "benign", "retracted")
INCIDENT_POSITIVE = ("official_confirmation", "report", "attacker_allegation")
CHANGE_POSITIVE = ("official_announcement", "report", "speculation")
ACTIVE_EVIDENCE = ("contracted", "observed")


def priority(column: str | Column, table: dict[str, int]) -> Column:
    """The number that ``table`` gives to a value; null for others."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column) if isinstance(column, str) else column]


def some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def every(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(False))


def cascade(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0])).otherwise(otherwise)


def sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def organization_link(active: str = "active", status: str = "link_status", organization: str = "organization_id") -> tuple[Column, Column]:
    """Aggregates for the set of exactly linked organizations and the strongest link state."""
    exact = F.collect_set(F.when(F.col(active) & (F.col(status) == "exact"), F.col(organization)))
    return exact, F.max_by(F.col(status), priority(status, LINK_STATES))


def resolve_link(exact: str, strongest: str) -> tuple[Column, Column]:
    """One exact organization is taken, several need a review, without any the strongest state stands."""
    n = F.size(exact)
    return F.when(n == 1, F.get(F.col(exact), F.lit(0))), F.when(n == 1, "exact").when(n > 1, "review_required").otherwise(F.col(strongest))


def reconcile_incidents(claims: DataFrame, spec: RevisionSpec = RevisionSpec()) -> DataFrame:
    """Incidents from their claims: type, best wording, status, organization, times and corroboration."""
    rows = effective(claims, spec)
    positive = F.col("active") & F.col("claim_type").isin(*INCIDENT_POSITIVE)
    official = positive & (F.col("claim_type") == "official_confirmation")
    exact, strongest = organization_link()
    best = F.max_by(F.struct("title", "summary"), F.struct(F.col("claim_type") == "official_confirmation", "confidence", "modified_at", "snapshot_id"))
    found = rows.groupBy("incident_key").agg(
        F.max_by("incident_type", priority("incident_type", INCIDENT_TYPES)).alias("incident_type"),
        best.alias("best"),
        some(official).alias("officially_confirmed"),
        some(positive).alias("_positive"),
        every(F.when(positive, F.col("claim_type") == "attacker_allegation")).alias("_alleged"),
        some(F.col("active") & (F.col("claim_type") == "denial")).alias("has_denial"),
        some(F.col("active") & (F.col("claim_type") == "retraction")).alias("has_retraction"),
        exact.alias("_exact"), strongest.alias("_strongest"),
        sorted_set(F.col("organization_name")).alias("claimed_organization_names"),
        F.min("published_at").alias("first_published_at"), F.max("modified_at").alias("last_updated_at"),
        F.count("*").alias("claim_count"),
        F.count_distinct(F.when(positive, F.col("independence_key"))).alias("independent_source_count"),
        every(F.col("historical_only")).alias("historical_only"),
    )
    organization, link = resolve_link("_exact", "_strongest")
    status = cascade(
        (F.col("officially_confirmed"), "confirmed"), (F.col("_positive") & F.col("_alleged"), "alleged"), (F.col("_positive"), "reported"),
        (F.col("has_denial"), "denied"), (F.col("has_retraction"), "retracted"), otherwise="under_review",
    )
    return found.select(
        "incident_key", "incident_type", "best.title", "best.summary", status.alias("status"), organization.alias("organization_id"), link.alias("organization_link_status"),
        "claimed_organization_names", "first_published_at", "last_updated_at", "claim_count", "independent_source_count", "officially_confirmed", "has_denial", "has_retraction", "historical_only",
    )


CHANGES = RevisionSpec(supersedes="supersedes_record_key")


def reconcile_changes(claims: DataFrame, as_of: Column, spec: RevisionSpec = CHANGES) -> DataFrame:
    """Change events from their claims; claims past ``expires_at`` are stale. A fully superseded event gives no row."""
    rows = effective(claims, spec)
    kind = F.col("claim_type")
    positive = F.col("active") & kind.isin(*CHANGE_POSITIVE)
    official = positive & (kind == "official_announcement")
    fresh = ~F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    best = F.struct(kind == "official_announcement", kind != "speculation", "confidence", "modified_at", "snapshot_id")
    exact, strongest = organization_link()
    found = rows.groupBy("event_key").agg(
        F.max_by(F.struct("event_type", "title"), best).alias("best"),
        some(official).alias("officially_confirmed"), some(official & fresh).alias("_fresh_official"),
        some(positive).alias("_positive"), some(positive & fresh).alias("_fresh"),
        every(F.when(positive & fresh, kind == "speculation")).alias("_speculative"),
        *[some(F.col("active") & (kind == k)).alias(f"has_{k}") for k in ("dispute", "correction", "retraction")],
        exact.alias("_exact"), strongest.alias("_strongest"),
        F.min("published_at").alias("first_published_at"), F.max("modified_at").alias("last_updated_at"), F.count("*").alias("claim_count"),
        F.count_distinct(F.when(positive, F.col("corroboration_key"))).alias("independent_source_count"), every(F.col("historical_only")).alias("historical_only"),
    )
    status = cascade(
        (F.col("_fresh_official"), "confirmed"), (F.col("has_dispute") & F.col("_fresh"), "disputed"), (F.col("_fresh") & F.col("_speculative"), "speculative"), (F.col("_fresh"), "reported"),
        (F.col("_positive"), "stale"), (F.col("has_retraction"), "retracted"), (F.col("has_correction"), "corrected"), (F.col("has_dispute"), "disputed"), otherwise="under_review",
    )
    organization, link = resolve_link("_exact", "_strongest")
    return found.select(
        "event_key", "best.event_type", "best.title", status.alias("status"), organization.alias("organization_id"), link.alias("organization_link_status"), "first_published_at", "last_updated_at",
        "claim_count", "independent_source_count", "officially_confirmed", "has_dispute", "has_correction", "has_retraction", "historical_only",
    )


def evidence_state(as_of: Column) -> dict[str, Column]:
    """Columns that say how relationship evidence stands at a time: stale, historical, current."""
    stale = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    historical = F.col("historical_only") | (F.col("evidence_class") == "historical") | F.coalesce(F.col("valid_until") <= as_of, F.lit(False))
    begun = F.coalesce(F.col("valid_from") <= as_of, F.lit(True))
    return {"is_stale": stale, "is_historical": historical, "is_current": F.col("active") & (F.col("claim_type") == "assertion") & ~stale & ~historical & begun}


def reconcile_relationships(evidence: DataFrame, as_of: Column, incumbent_roles: tuple[str, ...] = (), spec: RevisionSpec = CHANGES) -> DataFrame:
    """Relationships from their evidence: role, ten-way status, both ends, renewal and contract backing."""
    rows = effective(evidence, spec).withColumns(evidence_state(as_of))
    assertion = F.col("active") & (F.col("claim_type") == "assertion")
    contract = assertion & F.col("is_current") & (F.col("evidence_class") == "contracted")
    strength = priority("evidence_class", EVIDENCE_CLASSES)
    current = assertion & F.col("is_current")
    best = F.struct(F.col("claim_type") == "assertion", "is_current", strength, "confidence", "modified_at", "snapshot_id")
    ends = {}
    for end in ("source", "target"):
        exact, strongest = organization_link(status=f"{end}_link_status", organization=f"{end}_organization_id")
        ends |= {f"_{end}_exact": exact, f"_{end}_strongest": strongest}
    found = rows.groupBy("relationship_key").agg(
        F.max_by(F.struct("role", "evidence_class", "confidence"), best).alias("best"),
        (F.count_distinct(F.when(assertion, F.col("role"))) > 1).alias("has_role_conflict"),
        some(current).alias("_current"), some(current & F.col("evidence_class").isin(*ACTIVE_EVIDENCE)).alias("_active"),
        *[some(current & (F.col("evidence_class") == c)).alias(f"_{c}") for c in ("claimed", "inferred")],
        every(F.when(assertion, F.col("is_stale"))).alias("_stale"), every(F.when(assertion, F.col("is_historical"))).alias("_historical"),
        *[some(F.col("active") & (F.col("claim_type") == k)).alias(f"has_{k}") for k in ("dispute", "correction", "retraction")],
        some(contract).alias("has_contract_evidence"), F.min(F.when(contract & (F.col("renewal_at") >= as_of), F.col("renewal_at"))).alias("next_renewal_at"),
        F.max(F.when(assertion, F.col("confidence"))).alias("_confidence"), F.max_by(F.when(assertion, F.col("evidence_class")), F.when(assertion, strength)).alias("_class"),
        F.min(F.when(assertion, F.col("valid_from"))).alias("valid_from"), F.max(F.when(assertion, F.col("valid_until"))).alias("valid_until"),
        F.count("*").alias("evidence_count"), F.count_distinct(F.when(assertion, F.coalesce("independence_key", "source_id"))).alias("independent_source_count"),
        every(F.col("is_historical")).alias("historical_only"), *[c.alias(n) for n, c in ends.items()],
    )
    status = cascade(
        (F.col("has_role_conflict"), "under_review"), (F.col("has_dispute") & F.col("_current"), "disputed"), (F.col("_active"), "active"), (F.col("_claimed"), "claimed"), (F.col("_inferred"), "inferred"),
        (F.col("_stale"), "stale"), (F.col("_historical"), "historical"), (F.col("has_retraction"), "retracted"), (F.col("has_correction"), "corrected"), (F.col("has_dispute"), "disputed"), otherwise="under_review",
    )
    (source, source_link), (target, target_link) = (resolve_link(f"_{e}_exact", f"_{e}_strongest") for e in ("source", "target"))
    found = found.withColumns({"status": status, "_s": source, "_t": target, "_sl": source_link, "_tl": target_link})
    same = F.coalesce(F.col("_s") == F.col("_t"), F.lit(False))
    return found.select(
        "relationship_key", "best.role", "status", *[F.when(~same, F.col(f"_{x}")).alias(f"{e}_organization_id") for x, e in (("s", "source"), ("t", "target"))],
        *[F.when(same, "review_required").otherwise(F.col(f"_{x}l")).alias(f"{e}_link_status") for x, e in (("s", "source"), ("t", "target"))],
        "valid_from", "valid_until", "evidence_count", "independent_source_count", F.coalesce("_class", "best.evidence_class").alias("strongest_evidence_class"),
        F.coalesce("_confidence", "best.confidence").alias("confidence"), "has_contract_evidence",
        ((F.col("status") == "active") & F.col("has_contract_evidence") & F.col("best.role").isin(*incumbent_roles)).alias("contract_backed_current"),
        "next_renewal_at", "has_role_conflict", "has_dispute", "has_correction", "has_retraction", "historical_only",
    )


def reconcile_indicators(snapshots: DataFrame, spec: RevisionSpec = RevisionSpec()) -> DataFrame:
    """Indicators from their snapshots: the state of the most trusted source, conflicts, sightings."""
    rows = latest_by(snapshots, spec)
    order = F.struct("source_precedence", "modified_at", priority("state", INDICATOR_STATES), "snapshot_id")
    states = sorted_set(F.col("state"))
    found = rows.groupBy("indicator_key").agg(
        F.max_by("state", order).alias("state"), states.alias("observed_states"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max("modified_at").alias("last_updated_at"), F.count_distinct("source_id").alias("source_count"),
        F.count_distinct(F.when(F.col("active") & F.col("state").isin("malicious", "suspicious"), F.col("independence_key"))).alias("independent_source_count"),
        some(F.col("active")).alias("active"), some(F.col("state") == "shared_infrastructure").alias("shared_infrastructure"), every(F.col("historical_only")).alias("historical_only"),
    )
    conflict = F.size(F.array_intersect("observed_states", F.array(*map(F.lit, CONFLICTING_STATES)))) > 1
    return found.withColumn("has_conflict", conflict)


def merge_relations(snapshots: DataFrame, spec: RevisionSpec = RevisionSpec()) -> DataFrame:
    """The most confident relation for each (indicator, type, target); ``relations`` is an array of structs."""
    rows = latest_by(snapshots, spec).select("indicator_key", "snapshot_id", F.explode("relations").alias("r"))
    return rows.groupBy("indicator_key", "r.relation_type", "r.target_key").agg(F.max("r.confidence").alias("confidence"))


def reconcile_single_valued(claims: DataFrame, key: str, values: list[str], as_of: Column, spec: RevisionSpec) -> DataFrame:
    """Professional facts of one key: the live basis at a time, and whether live claims disagree.

    Claims are live when active and within [valid_from, valid_until); without a live claim the newest
    of all is the basis. Values are compared in lower case.
    """
    rows = effective(claims, spec)
    live = F.col("active") & F.coalesce(F.col("valid_from") <= as_of, F.lit(True)) & F.coalesce(F.col("valid_until") > as_of, F.lit(True))
    shown = F.struct(*values)
    lowered = F.struct(*[F.lower(v).alias(v) for v in values])
    order = F.struct("modified_at", "snapshot_id")
    found = rows.groupBy(key).agg(
        F.max_by(F.when(live, shown), F.when(live, order)).alias("_live"), F.max_by(shown, order).alias("_any"),
        F.count_distinct(F.when(live, lowered)).alias("_n"), F.count(F.when(live, 1)).alias("live_claims"), F.max(F.when(live, F.col("confidence"))).alias("confidence"),
    )
    basis = F.coalesce("_live", "_any")
    return found.select(key, *[basis[v].alias(v) for v in values], (F.col("_n") > 1).alias("has_conflict"), "live_claims", "confidence", (F.col("live_claims") == 0).alias("historical_only"))


def reconcile_assets(observations: DataFrame, as_of: Column, spec: RevisionSpec) -> DataFrame:
    """Assets from passive observations: whole history, effective statements and active ones feed different columns."""
    rows = effective(observations, spec).withColumn("_effective", F.lit(True))
    kept = rows.select(*spec.keys, "snapshot_id", "_effective")
    flagged = observations.join(kept, [*spec.keys, "snapshot_id"], "left").withColumn("_effective", F.coalesce("_effective", F.lit(False)))
    live = F.col("_effective") & F.col("active") & ~F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    exact = F.collect_set(F.when(live & (F.col("link_status") == "exact"), F.col("organization_id")))
    linked = F.collect_set(F.when(live, F.col("organization_id")))
    found = flagged.groupBy("asset_key").agg(
        F.count("*").alias("history_count"), F.count(F.when(F.col("_effective"), 1)).alias("effective_count"), F.count(F.when(live, 1)).alias("active_count"),
        F.min("published_at").alias("first_seen_at"), F.max(F.when(F.col("_effective"), F.col("modified_at"))).alias("last_updated_at"),
        F.max(F.when(live, F.col("confidence"))).alias("confidence"), exact.alias("_exact"), linked.alias("_linked"), some(live & F.col("attribution_risk")).alias("attribution_risk"),
    )
    sole = (F.size("_exact") == 1) & (F.size("_linked") == 1) & ~F.col("attribution_risk")
    status = F.when(sole, "exact").when(F.size("_linked") > 0, "review_required").otherwise("unresolved")
    return found.select("asset_key", "history_count", "effective_count", "active_count", "first_seen_at", "last_updated_at", "confidence", F.when(sole, F.get("_exact", F.lit(0))).alias("organization_id"), status.alias("organization_link_status"), "attribution_risk")
