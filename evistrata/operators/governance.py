"""What may run and what it brought: eligibility with ordered reasons, crawl scope, reviews, offers, source value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.functions.text import SERVICE_TERMS, lowered, service_families
from evistrata.functions.times import block_reasons, midnight

# Order of risks, states of plans that may run, offers of each service family, classes told by a signal's kind.
RISKS = ("low", "medium", "high", "prohibited")
RUNNABLE_PLANS = ("approved", "in_progress")
OFFERS = {
    "strategy_vciso": ("vCISO", "security strategy roadmap"),
    "audit_risk_assessment": ("security audit", "risk assessment"),
    "grc_compliance": ("GRC program", "compliance readiness"),
    "penetration_testing": ("penetration testing",),
    "red_purple_teaming": ("red team", "purple team"),
    "vulnerability_attack_surface": ("vulnerability management", "attack surface management"),
    "soc_siem_mdr_xdr_soar": ("SOC/SIEM engineering", "MDR and detection engineering"),
    "incident_response_dfir": ("incident response", "DFIR retainer"),
    "resilience_crisis_readiness": ("business continuity", "disaster recovery and crisis readiness"),
    "iam_iga_pam_zero_trust": ("IAM/PAM program", "Zero Trust"),
    "cloud_container_security": ("cloud security",),
    "appsec_devsecops": ("application security", "DevSecOps"),
    "network_sase_security": ("network security", "SASE/SSE"),
    "data_protection": ("data security", "privacy engineering"),
    "third_party_supply_chain": ("third-party risk", "supply-chain security"),
    "ot_ics_iot_security": ("OT/ICS/IoT security",),
    "awareness_training": ("security awareness training",),
    "product_integration_migration": ("security product integration", "security migration"),
    "cyber_insurance_readiness": ("cyber-insurance readiness",),
}
TENDER_CLASSES, JOB_CLASSES = ("explicit_procurement",), ("capability_gap", "program_build_transformation", "skills_training")
MIME_TYPES = (
    "application/atom+xml", "application/json", "application/ld+json", "application/pdf", "application/rss+xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/xml", "text/html", "text/plain", "text/xml",
)
MAX_DEPTH, MAX_PAGES, MAX_TOTAL_BYTES, MAX_RESOURCE_BYTES, MAX_REDIRECTS = 3, 250, 25_000_000, 5_000_000, 5
# The state to which an analyst's action brings an opportunity.
REVIEWS = {"qualify": "qualified", "reject": "rejected", "snooze": "snoozed", "request_enrichment": "enrichment_requested", "reopen": "needs_review"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))])


def service_family(value: Column) -> Column:
    """The family that an identifier names, in any case and with any space around it; null for none."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*SERVICE_TERMS), v)


def family_identifiers(value: Column) -> Column:
    """All identifiers under which rows of a family may be stored."""
    return F.array_compact(F.array(service_family(value)))


def offers(families: Column) -> Column:
    """Offers for an array of families, in their order, each once."""
    return F.array_distinct(F.flatten(F.transform(families, lambda f: F.coalesce(_map(OFFERS)[f], F.array().cast("array<string>")))))


def map_signals(signals: DataFrame) -> DataFrame:
    """Signals with service families and hypothesis classes: those that have none are classified by their text.

    A tender asks for what it names; a job posting tells of three needs. Others, and those without a
    known term, keep what they had. Every signal gets an independence key, that of its source if it has none.
    """
    classes = F.when(F.col("signal_type") == "public_tender", F.array(*map(F.lit, TENDER_CLASSES))).when(F.col("signal_type") == "job_posting", F.array(*map(F.lit, JOB_CLASSES)))
    mapped = (F.size("service_families") > 0) & (F.size("hypothesis_classes") > 0)
    asked = ~F.coalesce(mapped, F.lit(False)) & classes.isNotNull()
    families = F.transform(service_families(F.col("_low")), lambda x: x["family"])
    # a text is lowered once, and searched only where its families are asked for; a generator keeps both from being moved to each use
    rows = lowered(signals, F.when(asked, F.concat_ws(" ", "title", "summary")))
    rows = rows.withColumns({"_classes": classes, "_families": F.explode(F.array(F.when(F.col("_low").isNotNull(), families)))}).drop("_low")
    new = F.col("_families").isNotNull() & (F.size("_families") > 0)
    return rows.withColumns({
        "service_families": F.when(new, F.col("_families")).otherwise(F.col("service_families")), "hypothesis_classes": F.when(new, F.col("_classes")).otherwise(F.col("hypothesis_classes")),
        "is_explicit": F.col("is_explicit") | (new & (F.col("signal_type") == "public_tender")), "independence_key": F.coalesce("independence_key", F.concat(F.lit("source:"), F.col("source_id"))),
    }).drop("_families", "_classes")


def decide_steps(steps: DataFrame, plans: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """``step_id, allowed, next_state, reasons`` of research steps: all reasons that block, in a fixed order.

    ``plans`` has the allowed sources, tools, hosts and budgets of each ``plan_id``, ``usage`` what it has used.
    """
    rows = steps.join(plans, "plan_id").join(usage, "plan_id", "left").na.fill(0, ["completed_steps", "automated_steps"]).na.fill(0.0, ["cost_used"])
    risk = lambda c: F.array_position(F.array(*map(F.lit, RISKS)), F.col(c))
    auto, linked = F.col("mode") == "automated_adapter", F.col("mode").isin("automated_adapter", "manual_link")
    host = F.regexp_replace(F.lower(F.regexp_extract("target_url", r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    path = F.regexp_extract("target_url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    no_url = F.col("target_url").isNull()
    reasons = block_reasons(
        plan_not_approved=~F.col("plan_state").isin(*RUNNABLE_PLANS), plan_expired=F.col("plan_expires_at") <= now, step_not_approved=~F.array_contains("approved_steps", F.col("step_key")),
        source_not_allowed=~F.array_contains("allowed_sources", F.col("source_id")), tool_not_allowed=~F.array_contains("allowed_tools", F.col("tool_id")), purpose_mismatch=F.col("purpose") != F.col("plan_purpose"),
        category_mismatch=F.col("category") != F.col("plan_category"), risk_not_allowed=risk("risk") > risk("max_risk"), step_budget_exhausted=F.col("completed_steps") >= F.col("max_steps"),
        automation_budget_exhausted=auto & (F.col("automated_steps") >= F.col("max_automated_steps")), step_cost_exceeds_limit=F.col("cost") > F.col("max_step_cost"),
        total_cost_budget_exhausted=F.col("cost_used") + F.col("cost") > F.col("max_total_cost"), target_url_required=linked & no_url,
        target_scheme_not_allowed=linked & ~no_url & ~F.lower("target_url").startswith("https://"), target_host_not_allowed=linked & ~no_url & ~F.array_contains("allowed_hosts", host),
        target_path_not_allowed=linked & ~no_url & (F.size("allowed_paths") > 0) & ~F.exists("allowed_paths", lambda p: F.startswith(path, p)),
        source_not_executable=auto & ~F.col("source_executable"), quota_exhausted=auto & (F.col("quota_remaining") == 0),
    )
    state = F.when(F.size("reasons") > 0, "blocked").when(F.col("mode") == "manual_link", "manual_action_required").otherwise("ready")
    return rows.withColumn("reasons", reasons).select("step_id", (F.size("reasons") == 0).alias("allowed"), state.alias("next_state"), "reasons")


def decide_requests(requests: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """``request_id, allowed, reasons`` of requests to conditional providers, against the approval of their source."""
    rows = requests.join(approvals, "source_id", "left")
    within = lambda asked, given: F.size(F.array_except(asked, F.coalesce(given, F.array().cast("array<string>")))) == 0
    reasons = block_reasons(
        dossier_not_approved=F.coalesce(F.col("approval_state") != "approved", F.lit(True)), dossier_expired=F.col("approval_expires_at") <= now, access_method_not_approved=F.col("access_method") != F.col("approved_method"),
        scope_not_approved=~within("scopes", "approved_scopes"), field_not_approved=~within("fields", "approved_fields"), purpose_not_approved=~F.array_contains("approved_purposes", F.col("purpose")),
        category_not_approved=~F.array_contains("approved_categories", F.col("category")), retention_exceeds_approval=F.col("approved_days").isNull() | (F.col("retention_days") > F.col("approved_days")),
        automation_not_approved=F.col("automated") & ~F.col("automation_allowed"), account_mismatch=F.col("approved_account").isNotNull() & ~F.col("account").eqNullSafe(F.col("approved_account")),
    )
    return rows.withColumn("reasons", reasons).select("request_id", (F.size("reasons") == 0).alias("allowed"), "reasons")


def review_opportunities(opportunities: DataFrame, actions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Opportunities after one analyst's action each, and the audit of what was done.

    A rejection needs a note and a snooze an end in the future; an action without them changes nothing.
    """
    met = opportunities.join(actions, "opportunity_id", "left")
    blank = F.coalesce(F.trim("note") == "", F.lit(True))
    lacking = ((F.col("action") == "reject") & blank) | ((F.col("action") == "snooze") & F.coalesce(F.col("until") <= now, F.lit(True)))
    met = met.withColumn("new_state", F.when(~lacking, _map(REVIEWS)[F.col("action")]))
    done = F.col("new_state").isNotNull()
    after = met.select("opportunity_id", F.coalesce("new_state", "state").alias("state"), F.when(F.col("new_state") == "snoozed", F.col("until")).when(~done, F.col("snoozed_until")).alias("snoozed_until"))
    audit = met.filter("action is not null").select("opportunity_id", "action", F.col("state").alias("previous_state"), F.coalesce("new_state", "state").alias("new_state"), done.alias("applied"))
    return after, audit


# States of a source's health, and those in which it must not run.
BLOCKING = ("authorization_expired", "quota_exhausted", "cost_budget_exhausted")


def source_freshness(health: DataFrame, now: Column, known: DataFrame | None = None) -> DataFrame:
    """``source_id, freshness, may_run``: what bars a source comes first, then how old its last success is.

    ``health`` has ``source_id, last_success_at, max_age`` (seconds), ``historical_only, executable`` and, where known, ``authorization_expires_at,
    quota_remaining, next_cost, cost_used, cost_limit``. Order: authorization, quota, cost of the next request, historical, no success yet, age.
    Sources of ``known`` (``source_id``) that ``health`` lacks may run; their freshness is null.
    """
    have = lambda c, kind: F.col(c) if c in health.columns else F.lit(None).cast(kind)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success_at").cast("timestamp"))) / 1_000_000
    cost = F.coalesce(have("next_cost", "double"), F.lit(0.0))
    state = (
        F.when(have("authorization_expires_at", "timestamp_ntz") <= now, "authorization_expired").when(have("quota_remaining", "long") == 0, "quota_exhausted")
        .when((cost > 0) & (F.coalesce(have("cost_used", "double"), F.lit(0.0)) + cost > have("cost_limit", "double")), "cost_budget_exhausted").when(F.col("historical_only"), "historical_only")
        .when(age.isNull(), "stale_refresh_queued").when(age <= F.col("max_age") / 2, "fresh").when(age <= F.col("max_age"), "aging").otherwise("stale_refresh_queued")
    )
    found = health.select("source_id", state.alias("freshness"), (F.coalesce("executable", F.lit(False)) & ~state.isin(*BLOCKING)).alias("may_run"))
    if known is None:
        return found
    return found.unionByName(known.select("source_id").distinct().join(health, "source_id", "left_anti").select("source_id", F.lit(None).cast("string").alias("freshness"), F.lit(True).alias("may_run")))


def audit_activation(records: DataFrame) -> DataFrame:
    """One row: totals by how far sources are, the unresolved ones, duplicate keys and references to unknown sources."""
    dangling = records.filter("refers_to is not null").join(records.select(F.col("source_id").alias("refers_to")).distinct(), "refers_to", "left_anti").agg(F.count("*").alias("dangling"))
    twice = records.groupBy("source_id").count().filter("count > 1").agg(F.count("*").alias("duplicates"))
    found = records.agg(
        F.count("*").alias("total"), F.count_if("integrated").alias("fully_integrated"), F.count_if(F.col("resolved") & ~F.col("integrated")).alias("resolved_non_executable"), F.count_if(~F.col("resolved")).alias("unresolved"),
    )
    return found.crossJoin(F.broadcast(dangling)).crossJoin(F.broadcast(twice))


def plan_usage(steps: DataFrame) -> DataFrame:
    """Per plan the completed steps, the distinct automated ones and their cost; a step that repeats costs the most that it was told with."""
    done = steps.filter("state = 'completed'").groupBy("plan_id").agg(F.count("*").alias("completed_steps"))
    auto = steps.filter("mode = 'automated_adapter' and state = 'completed'").groupBy("plan_id", "step_key").agg(F.max("cost").alias("cost")).groupBy("plan_id").agg(F.count("*").alias("automated_steps"), F.sum("cost").alias("cost_used"))
    return done.join(auto, "plan_id", "left").na.fill(0, ["automated_steps"]).na.fill(0.0, ["cost_used"])


def value_with_and_without(events: DataFrame, source: str, amounts: Sequence[str]) -> DataFrame:
    """One row: number and sums of all events and of those of other sources."""
    other = F.col("source_id") != source
    parts = [F.count("*").alias("events_with"), F.count_if(other).alias("events_without")]
    for a in amounts:
        parts += [F.coalesce(F.sum(a), F.lit(0)).alias(f"{a}_with"), F.coalesce(F.sum(F.when(other, F.col(a))), F.lit(0)).alias(f"{a}_without")]
    return events.agg(*parts)


def contract_relationships(contracts: DataFrame, observed_at: Column) -> tuple[DataFrame, DataFrame]:
    """Relationship evidence and contexts from contracts: every provider supplies the buyer, from the contract's date on.

    ``contracts`` has ``contract_id, buyer_id, providers array<bigint>, signed_on date, ends_on date, families array<string>, confidence``.
    """
    each = contracts.withColumn("provider_id", F.explode("providers"))
    key = F.concat_ws(">", F.col("provider_id").cast("string"), F.col("buyer_id").cast("string"))
    evidence = each.select(
        key.alias("relationship_key"), "provider_id", "buyer_id", F.lit("supplier").alias("role"), F.lit("contracted").alias("evidence_class"), midnight(F.col("signed_on")).alias("valid_from"),
        midnight(F.col("ends_on")).alias("valid_until"), observed_at.alias("observed_at"), "confidence", F.concat(F.lit("contract:"), F.col("contract_id").cast("string")).alias("source_record_key"),
    )
    contexts = each.select(key.alias("relationship_key"), F.explode("families").alias("value")).distinct().withColumn("context_type", F.lit("service_family"))
    return evidence, contexts
