"""Fusing signals to need hypotheses, and bounded explainable scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.reconcile import every, some

RESEARCH_ONLY = "research_only_weak_signal"
# Caps and weights of the confidence, freshness steps in days, time to live in days by horizon,
# and below them the classes by urgency and the terms of tenders and of job postings.
WEAK_CAP, HISTORICAL_CAP, RESEARCH_CAP = 0.58, 0.45, 0.40
CONTRADICTION, NEGATIVE = 0.40, 0.30
FRESHNESS = ((30, 1.0), (90, 0.9), (180, 0.75), (365, 0.55))
OLDEST = 0.35
TTL_DAYS = {"immediate": 30, "near_term": 90, "medium_term": 180, "long_term": 365}
IMMEDIATE = ("incident_urgency",)
HIGH = ("explicit_procurement", "contract_renewal_replacement", "regulatory_deadline_gap")
MEDIUM = ("technology_risk_lifecycle", "external_exposure", "provider_dissatisfaction_transition")
TENDER_TERMS = ("siem", "soc", "security operations center", "managed detection and response", "mdr", "xdr", "log management", "security monitoring")
JOB_TERMS = ("soc analyst", "soc manager", "siem engineer", "security operations", "splunk", "microsoft sentinel", "sekoia", "xdr")


def age_days(at: str, as_of: Column) -> Column:
    """Days from ``at`` to ``as_of``, 0 where it lies in the future."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def freshness(at: str, as_of: Column) -> Column:
    days, steps = age_days(at, as_of), F.when(F.lit(False), 0.0)
    for most, value in FRESHNESS:
        steps = steps.when(days <= most, value)
    return steps.otherwise(OLDEST)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def eligible(signals: DataFrame, as_of: Column) -> DataFrame:
    """One row per signal, hypothesis class and service family; expired signals and empty lists drop out."""
    live = signals.filter(F.col("organization_id").isNotNull() & F.coalesce(F.col("expires_at") > as_of, F.lit(True)))
    return live.withColumn("requested_class", F.explode("hypothesis_classes")).withColumn("family", F.explode("service_families"))


def fuse(signals: DataFrame, as_of: Column) -> DataFrame:
    """Need hypotheses for every (organization, class, family) with at least one supporting signal.

    Correlated signals count once, as the strongest of their corroboration key. The first aggregation
    is by corroboration key, the second by group, so a busy organization is reduced before it is
    gathered. ``confidence`` is unrounded.
    """
    group = ["organization_id", "requested_class", "family"]
    rows = eligible(signals, as_of).withColumn("fresh", freshness("effective_at", as_of))
    support = F.col("polarity") == "supporting"
    strongest = F.max_by(F.struct("confidence", "fresh", "is_explicit", "historical_only", "signal_type"), F.when(support, F.struct("confidence", -F.col("signal_id"))))
    expiry = F.min(F.when(F.col("expires_at") > as_of, F.col("expires_at")))
    by_key = rows.groupBy(*group, "corroboration_key").agg(
        strongest.alias("s"), F.count(F.when(support, 1)).alias("n"), F.max(F.when(F.col("polarity") == "contradicting", F.col("confidence"))).alias("contra"),
        F.max(F.when(F.col("polarity") == "negative", F.col("confidence"))).alias("negative"), expiry.alias("expiry"), F.count("*").alias("signals"),
    )
    has = F.col("n") > 0
    found = by_key.groupBy(*group).agg(
        F.count(F.when(has, 1)).alias("independent"), F.sum("n").alias("supporting"), F.sum("signals").alias("signals"), F.max(F.when(has, F.col("s.confidence") * F.col("s.fresh"))).alias("best"),
        F.max(F.when(has, F.col("s.confidence"))).alias("strongest"), some(has & F.col("s.is_explicit")).alias("explicit"), every(F.when(has, F.col("s.historical_only"))).alias("historical"),
        every(F.when(has, F.col("s.signal_type") == "research_discovery")).alias("research"), F.coalesce(F.max("contra"), F.lit(0.0)).alias("contra"), F.coalesce(F.max("negative"), F.lit(0.0)).alias("negative"), F.min("expiry").alias("expiry"),
    ).filter("independent > 0")
    weak = F.col("historical") | F.col("research") | ((F.col("independent") < 2) & ~F.col("explicit") & (F.col("strongest") < 0.75))
    score = F.col("best") + F.least(F.lit(0.16), (F.col("independent") - 1) * 0.08) + F.when(F.col("explicit"), 0.12).otherwise(0.0) - F.col("contra") * CONTRADICTION - F.col("negative") * NEGATIVE
    score = clamp(score)
    score = F.when((F.col("independent") == 1) & ~F.col("explicit"), F.least(score, F.lit(WEAK_CAP))).otherwise(score)
    score = F.when(F.col("historical"), F.least(score, F.lit(HISTORICAL_CAP))).otherwise(score)
    score = F.when(F.col("research"), F.least(score, F.lit(RESEARCH_CAP))).otherwise(score)
    kind = F.col("hypothesis_class")
    urgency = F.when(kind.isin(*IMMEDIATE), "immediate").when(kind.isin(*HIGH), "high").when(kind == RESEARCH_ONLY, "low").otherwise("medium")
    horizon = F.when(kind.isin(*IMMEDIATE), "immediate").when(kind.isin(*HIGH, *MEDIUM), "near_term").when(kind == RESEARCH_ONLY, "long_term").otherwise("medium_term")
    ttl = F.create_map(*[F.lit(x) for kv in TTL_DAYS.items() for x in kv])[F.col("horizon")]
    found = found.withColumn("hypothesis_class", F.when(weak, RESEARCH_ONLY).otherwise(F.col("requested_class"))).withColumns({"confidence": score, "urgency": urgency, "horizon": horizon})
    return found.withColumn("expires_at", F.least(F.col("expiry"), as_of + F.make_dt_interval(ttl))).select(
        *group, "hypothesis_class", "confidence", "urgency", "horizon", "expires_at", "independent", "supporting", "signals"
    )


def contributions(signals: DataFrame, as_of: Column) -> DataFrame:
    """What each independent source adds to a group: net support with its sign."""
    rows = eligible(signals, as_of).withColumn("fresh", freshness("effective_at", as_of))
    part = lambda p, x: F.coalesce(F.max(F.when(F.col("polarity") == p, x)), F.lit(0.0))
    found = rows.groupBy("organization_id", "requested_class", "family", "corroboration_key").agg(
        part("supporting", F.col("confidence") * F.col("fresh")).alias("s"), part("contradicting", F.col("confidence")).alias("c"), part("negative", F.col("confidence")).alias("n"), F.max("confidence").alias("max_confidence"), F.count("*").alias("signals")
    )
    net = clamp(F.col("s") - F.col("c") * CONTRADICTION - F.col("n") * NEGATIVE, -1.0)
    polarity = F.when(F.col("net") >= 0, "supporting").when(F.col("c") >= F.col("n"), "contradicting").otherwise("negative")
    return found.withColumn("net", net).withColumn("polarity", polarity).select("organization_id", "requested_class", "family", "corroboration_key", "polarity", "max_confidence", F.col("net").alias("contribution"), "signals")


def has_term(text: Column, terms) -> Column:
    """Whether the lower-cased text contains one of the terms, anywhere."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def buying_intent(signals: DataFrame, as_of: Column, window_days: int = 90, ttl_days: int = 30) -> DataFrame:
    """Opportunity scores per organization from recent tenders and job postings, with their components.

    A signal counts if its title, summary or matched terms contain a term of its kind. ``components`` is an
    array of (rule, value, weight, kind); ``score`` is their weighted sum within 0..100, penalties taken away.
    """
    tender, job = F.col("signal_type") == "public_tender", F.col("signal_type") == "job_posting"
    recent = signals.filter((F.col("effective_at") >= as_of - F.make_dt_interval(F.lit(window_days))) & F.coalesce(F.col("expires_at") > as_of, F.lit(True)))
    said = F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "matched_terms"))
    matched = recent.filter(F.when(tender, has_term(said, TENDER_TERMS)).otherwise(has_term(said, JOB_TERMS)))
    mean = F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("*")  # the same in any order of rows
    per = matched.groupBy("organization_id").agg(
        F.count(F.when(tender, 1)).alias("tenders"), F.count(F.when(job, 1)).alias("jobs"), F.max("effective_at").alias("last_evidence_at"), mean.alias("confidence"), F.count_distinct("evidence_id").alias("evidence"), F.count("*").alias("signals")
    )
    both = (F.col("tenders") > 0) & (F.col("jobs") > 0)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    fresh = F.greatest(F.lit(0.0), 1.0 - age_days("last_evidence_at", as_of) / window_days)
    # fixed values: the rules of the score with their weights
    rules = (
        ("public-tender-intent", one(F.col("tenders") > 0), 45.0), ("security-operations-hiring", F.least(F.col("jobs") / 3.0, F.lit(1.0)), 25.0), ("cross-source-corroboration", one(both), 15.0),
        ("signal-freshness", F.round(fresh, 6), 10.0), ("evidence-confidence", F.round("confidence", 6), 5.0), ("single-source-penalty", F.when(F.col("evidence") == 1, 0.25).otherwise(0.0), 20.0),
    )
    parts = F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("value"), F.lit(w).alias("weight"), F.lit("penalty" if r.endswith("penalty") else "reward").alias("kind")) for r, v, w in rules])
    scored = per.withColumn("components", parts).withColumn("raw_score", F.aggregate("components", F.lit(0.0), lambda s, c: s + signed(c["value"] * c["weight"], c["kind"])))
    quality = F.when(both & (F.col("evidence") >= 2), "complete").otherwise("partial")
    return scored.withColumns({"score": clamp(F.col("raw_score"), 0.0, 100.0), "data_quality": quality, "expires_at": as_of + F.make_dt_interval(F.lit(ttl_days))})


def signed(amount: Column, kind: Column) -> Column:
    """What a component adds: penalties are taken away."""
    return F.when(kind == "penalty", -amount).otherwise(amount)


def override(components: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scores after analysts replaced values of rules; ``components`` is one row per (organization, rule)."""
    o = overrides.select("organization_id", "rule", F.col("value").alias("analyst_value"))
    merged = components.join(o, ["organization_id", "rule"], "left").withColumn("used", F.coalesce("analyst_value", "value"))
    return merged.groupBy("organization_id").agg(clamp(F.sum(signed(F.col("used") * F.col("weight"), F.col("kind"))), 0.0, 100.0).alias("score"), F.count("analyst_value").alias("overridden"))


def rank_sources(options: DataFrame) -> DataFrame:
    """Viable research sources in order of preference within each purpose."""
    score = 0.45 * F.col("value") + 0.35 * F.col("freshness") - 0.15 * F.least(F.col("cost") / 100.0, F.lit(1.0)) - 0.25 * F.col("risk")
    w = Window.partitionBy("purpose").orderBy(F.col("score").desc(), "mode", "cost", "source_id")
    return options.filter("viable").withColumn("score", score).withColumn("rank", F.row_number().over(w))


def source_options(sources: DataFrame, purpose: str, category: str, health: DataFrame, values: DataFrame, costs: DataFrame, risks: DataFrame, approvals: DataFrame) -> DataFrame:
    """What ``rank_sources`` ranks: every source of a purpose with its health, value, cost, risk and approval, each by the source's id.

    A source is viable if it is executable, neither stale nor blocked, and approved for the category where
    that needs an approval. What a table does not know counts as nothing.
    """
    rows = sources.filter(F.array_contains("purposes", purpose) & F.array_contains("categories", category))
    for d in (health.select("source_id", "freshness_state"), values.groupBy("source_id").agg(F.avg("value").alias("value")), costs.groupBy("source_id").agg(F.sum("cost").alias("cost")), risks.groupBy("source_id").agg(F.max("risk").alias("risk")), approvals.select("source_id", F.lit(True).alias("approved"))):
        rows = rows.join(d, "source_id", "left")
    fresh = F.when(F.col("freshness_state") == "fresh", 1.0).when(F.col("freshness_state") == "aging", 0.5).otherwise(0.0)
    viable = F.col("executable") & F.coalesce(F.col("freshness_state") != "stale", F.lit(True)) & (~F.col("needs_approval") | F.coalesce("approved", F.lit(False)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.select("source_id", F.lit(purpose).alias("purpose"), zero("value"), fresh.alias("freshness"), zero("cost"), zero("risk"), "mode", viable.alias("viable"))
