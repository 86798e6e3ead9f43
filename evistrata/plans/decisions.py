"""Registered queries over signals, scores, graph, applicability and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import applicability, fusion, graph, metrics
from evistrata.plans.bindings import AS_OF, sql, table, view
from evistrata.plans.evidence import FROM_ALL, LATEST, as_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


FRESH = f"""CASE WHEN greatest(0.0, (epoch_us({AS_OF}) - epoch_us(effective_at)) / 86400000000.0::double) <= 30 THEN 1.0 WHEN (epoch_us({AS_OF}) - epoch_us(effective_at)) / 86400000000.0::double <= 90 THEN 0.9
    WHEN (epoch_us({AS_OF}) - epoch_us(effective_at)) / 86400000000.0::double <= 180 THEN 0.75 WHEN (epoch_us({AS_OF}) - epoch_us(effective_at)) / 86400000000.0::double <= 365 THEN 0.55 ELSE 0.35 END::double"""
ROWS = f"""WITH e AS (SELECT *, {FRESH} AS fresh FROM v_signal WHERE coalesce(expires_at > {AS_OF}, true)),
    c AS (SELECT e.*, unnest(hypothesis_classes) AS requested_class FROM e), r AS (SELECT c.*, unnest(service_families) AS family FROM c)"""
FUSED = f"""{ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY organization_id, requested_class, family, corroboration_key ORDER BY confidence DESC, signal_id) = 1 AS top FROM r WHERE polarity = 'supporting'),
    g AS (SELECT organization_id, requested_class, family, count(*) FILTER (top) AS independent, count(*) AS supporting, max(confidence * fresh) FILTER (top) AS best, max(confidence) FILTER (top) AS strongest,
        bool_or(is_explicit) FILTER (top) AS explicit, bool_and(historical_only) FILTER (top) AS historical, bool_and(signal_type = 'research_discovery') FILTER (top) AS research FROM s GROUP BY ALL),
    x AS (SELECT organization_id, requested_class, family, coalesce(max(confidence) FILTER (polarity = 'contradicting'), 0) AS contra, coalesce(max(confidence) FILTER (polarity = 'negative'), 0) AS negative, min(expires_at) AS expiry, count(*) AS signals FROM r GROUP BY ALL),
    y AS (SELECT *, greatest(0.0::double, least(1.0::double, best + least(0.16::double, (independent - 1) * 0.08::double) + CASE WHEN explicit THEN 0.12::double ELSE 0.0::double END - contra * 0.4::double - negative * 0.3::double)) AS z FROM g JOIN x USING (organization_id, requested_class, family)),
    k AS (SELECT *, CASE WHEN independent = 1 AND NOT explicit THEN least(z, 0.58::double) ELSE z END AS z1, CASE WHEN historical OR research OR (independent < 2 AND NOT explicit AND strongest < 0.75::double) THEN 'research_only_weak_signal' ELSE requested_class END AS hypothesis_class FROM y),
    l AS (SELECT *, CASE WHEN historical THEN least(z1, 0.45::double) ELSE z1 END AS z2 FROM k)"""


@registered(f"""{FUSED} SELECT organization_id, requested_class, family, hypothesis_class, round(CASE WHEN research THEN least(z2, 0.4::double) ELSE z2 END, 9) AS confidence, independent, supporting, signals,
    least(expiry, {AS_OF} + to_days(CASE WHEN hypothesis_class = 'incident_urgency' THEN 30 WHEN hypothesis_class IN ('explicit_procurement', 'external_exposure') THEN 90 WHEN hypothesis_class = 'research_only_weak_signal' THEN 365 ELSE 180 END)) AS expires_at FROM l""")
def fuse_hypotheses(spark, sf_dir):
    found = fusion.fuse(view(spark, sf_dir, "v_signal"), as_of())
    return found.select("organization_id", "requested_class", "family", "hypothesis_class", F.round("confidence", 9).alias("confidence"), "independent", "supporting", "signals", "expires_at")


@registered(f"""{ROWS}, p AS (SELECT organization_id, requested_class, family, corroboration_key, coalesce(max(confidence * fresh) FILTER (polarity = 'supporting'), 0) AS s, coalesce(max(confidence) FILTER (polarity = 'contradicting'), 0) AS c,
        coalesce(max(confidence) FILTER (polarity = 'negative'), 0) AS n, count(*) AS signals FROM r GROUP BY ALL), q AS (SELECT *, greatest(-1.0::double, least(1.0::double, s - c * 0.4::double - n * 0.3::double)) AS net FROM p)
    SELECT organization_id, requested_class, family, corroboration_key, CASE WHEN net >= 0 THEN 'supporting' WHEN c >= n THEN 'contradicting' ELSE 'negative' END AS polarity, round(net, 9) AS contribution, signals FROM q""")
def source_contributions(spark, sf_dir):
    found = fusion.contributions(view(spark, sf_dir, "v_signal"), as_of())
    return found.select("organization_id", "requested_class", "family", "corroboration_key", "polarity", F.round("contribution", 9).alias("contribution"), "signals")


MATCHED = f"""WITH m AS (SELECT * FROM v_signal WHERE effective_at >= {AS_OF} - to_days(90) AND coalesce(expires_at > {AS_OF}, true)
        AND CASE WHEN signal_type = 'public_tender' THEN regexp_matches(lower(title || ' ' || summary || ' ' || matched_terms[1]), 'siem|soc|security operations center|managed detection and response|mdr|xdr|log management|security monitoring')
            ELSE regexp_matches(lower(title || ' ' || summary || ' ' || matched_terms[1]), 'soc analyst|soc manager|siem engineer|security operations|splunk|microsoft sentinel|sekoia|xdr') END),
    p AS (SELECT organization_id, count(*) FILTER (signal_type = 'public_tender') AS tenders, count(*) FILTER (signal_type = 'job_posting') AS jobs, max(effective_at) AS last_evidence_at, round((sum(confidence::decimal(18,9))::double / count(*))::varchar::decimal(38,20), 6)::double AS confidence, count(DISTINCT evidence_id) AS evidence FROM m GROUP BY 1),
    v AS (SELECT *, CASE WHEN tenders > 0 THEN 1.0 ELSE 0.0 END AS a, least(jobs / 3.0::double, 1.0::double) AS b, CASE WHEN tenders > 0 AND jobs > 0 THEN 1.0 ELSE 0.0 END AS c,
        round(greatest(0.0::double, 1 - greatest(0.0::double, (epoch_us({AS_OF}) - epoch_us(last_evidence_at)) / 86400000000.0::double) / 90)::varchar::decimal(38,20), 6)::double AS d, CASE WHEN evidence = 1 THEN 0.25 ELSE 0.0 END AS f FROM p)"""


@registered(f"""{MATCHED} SELECT organization_id, tenders, jobs, last_evidence_at, round(greatest(0.0::double, least(100.0::double, a * 45 + b * 25 + c * 15 + d * 10 + confidence * 5 - f * 20)), 6) AS score,
    CASE WHEN tenders > 0 AND jobs > 0 AND evidence >= 2 THEN 'complete' ELSE 'partial' END AS data_quality FROM v""")
def buying_intent(spark, sf_dir):
    found = fusion.buying_intent(view(spark, sf_dir, "v_signal"), as_of())
    return found.select("organization_id", "tenders", "jobs", "last_evidence_at", F.round("score", 6).alias("score"), "data_quality")


@registered(f"""{MATCHED}, u AS (SELECT organization_id, a * 45 + CASE WHEN organization_id % 5 = 0 THEN 0.1::double ELSE b END * 25 + c * 15 + d * 10 + confidence * 5 - f * 20 AS t FROM v)
    SELECT organization_id, round(greatest(0.0::double, least(100.0::double, t)), 6) AS score, CASE WHEN organization_id % 5 = 0 THEN 1 ELSE 0 END AS overridden FROM u""")
def score_override(spark, sf_dir):
    found = fusion.buying_intent(view(spark, sf_dir, "v_signal"), as_of()).select("organization_id", F.explode("components").alias("c")).select("organization_id", "c.*")
    changed = found.filter("rule = 'security-operations-hiring' and organization_id % 5 = 0").select("organization_id", "rule", F.lit(0.1).alias("value"))
    return fusion.override(found, changed).withColumn("score", F.round("score", 6))


@registered("""SELECT c_custkey AS source_id, c_mktsegment AS purpose, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 0.45::double * ((c_custkey % 10) / 10) + 0.35::double * ((c_custkey % 7) / 7) - 0.15::double * least((c_custkey % 150) / 100.0::double, 1.0::double) - 0.25::double * ((c_custkey % 3) / 3) DESC, 'm' || (c_custkey % 2), c_custkey % 150, c_custkey) AS rank
    FROM customer WHERE c_acctbal > 0""")
def rank_sources(spark, sf_dir):
    k = F.col("c_custkey")
    options = table(spark, sf_dir, "customer").select(k.alias("source_id"), F.col("c_mktsegment").alias("purpose"), (k % 10 / 10).alias("value"), (k % 7 / 7).alias("freshness"), (k % 150).alias("cost"), (k % 3 / 3).alias("risk"), F.concat(F.lit("m"), k % 2).alias("mode"), (F.col("c_acctbal") > 0).alias("viable"))
    return fusion.rank_sources(options).select("source_id", "purpose", "rank")


COMPONENTS = """WITH RECURSIVE both AS (SELECT a, b FROM v_edge UNION SELECT b, a FROM v_edge), reach AS (SELECT a AS node, a AS seen FROM both UNION SELECT node, b FROM reach JOIN both ON seen = a),
    found AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)""".replace("both", "sides")


@registered(f"{COMPONENTS} SELECT node, component FROM found")
def connected_components(spark, sf_dir):
    return graph.components(view(spark, sf_dir, "v_edge"))


@registered(f"{COMPONENTS} SELECT component, min(node) AS canonical, count(*) AS members FROM found GROUP BY component")
def canonical_identifiers(spark, sf_dir):
    return graph.canonical_identifier(graph.components(view(spark, sf_dir, "v_edge")))


CUR = f"active AND coalesce(valid_from <= {AS_OF}, true) AND coalesce(valid_until > {AS_OF}, true)"


@registered(f"""WITH latest AS ({LATEST.format(v='v_change')}) SELECT node_key, arg_max(event_type, (modified_at, snapshot_id)) AS node_type, arg_max(title, (modified_at, snapshot_id)) AS display_name,
    CASE WHEN count(DISTINCT organization_id) FILTER ({CUR}) = 1 THEN max(organization_id) FILTER ({CUR}) END AS organization_id, max(confidence) AS confidence, count(DISTINCT source_id) AS modules, bool_or({CUR}) AS current, count(*) AS snapshots FROM latest GROUP BY node_key""")
def reconcile_nodes(spark, sf_dir):
    return graph.reconcile_nodes(view(spark, sf_dir, "v_change"), as_of())


NOW = f"{CUR} AND claim_type NOT IN ('dispute', 'retraction') AND coalesce(expires_at > {AS_OF}, true)"


@registered(f"""{FROM_ALL} SELECT event_key, CASE WHEN count(DISTINCT claim_type) FILTER ({NOW}) = 1 THEN max(claim_type) FILTER ({NOW}) WHEN count(DISTINCT claim_type) FILTER ({NOW}) > 1 THEN 'multiple' ELSE arg_max(claim_type, (modified_at, snapshot_id)) END AS basis,
    bool_or({NOW}) AS current, min(valid_from) AS valid_from, max(valid_until) AS valid_until, max(confidence) AS confidence, count(*) AS statements, bool_and(historical_only) AS historical_only FROM full_ GROUP BY event_key""")
def reconcile_edges(spark, sf_dir):
    return graph.reconcile_edges(view(spark, sf_dir, "v_change"), as_of())


@registered("""WITH m AS (SELECT identity_id, organization_id, CASE WHEN i.postal_code = o.postal_code THEN 0.92::double ELSE 0.75::double END AS score FROM v_identity i
    JOIN v_org o ON trim(regexp_replace(lower(i.name), '[^a-z0-9]+', ' ', 'g')) = regexp_replace(trim(regexp_replace(lower(o.name), '[^a-z0-9]+', ' ', 'g')), '( (sas|sa|sarl|gmbh|ltd|inc|llc))+$', ''))
    SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY score DESC, organization_id) AS rank FROM m""")
def match_candidates(spark, sf_dir):
    return graph.match_candidates(view(spark, sf_dir, "v_identity"), view(spark, sf_dir, "v_org"))


def _key(v: str) -> str:
    tokens = f"regexp_extract_all(lower(trim({v})), '[0-9]+|[a-z]+')"
    parts = f"list_transform({tokens}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '1' || lpad(t, 12, '0') ELSE '0' || t END)"
    return f"list_concat({parts}, list_transform(range(12 - len({tokens})), lambda i: '1000000000000'))"


@registered(f"""WITH t AS (SELECT *, CASE WHEN version IS NOT NULL THEN {_key('version')} END AS vk FROM v_technology), r AS (SELECT *, platform AS rp, {_key('introduced')} AS ik, {_key('fixed')} AS fk FROM v_range),
    m AS (SELECT technology_id, vulnerability_id, version, confidence, expired, range_id, rp IS NULL OR rp = t.platform AS fits, version IS NULL OR backported_fix OR (scheme = 'rpm' AND (lower(version) <> introduced OR lower(version) <> fixed)) AS unsure,
        CASE WHEN introduced_inclusive THEN vk >= ik ELSE vk > ik END AND CASE WHEN fixed_inclusive THEN vk <= fk ELSE vk < fk END AS inside FROM t JOIN r USING (vendor, product)),
    g AS (SELECT technology_id, vulnerability_id, any_value(version) AS version, any_value(confidence) AS confidence, any_value(expired) AS expired, bool_or(fits) AS fits, min(range_id) FILTER (fits AND NOT unsure AND inside) AS applies, min(range_id) FILTER (fits AND unsure) AS un FROM m GROUP BY 1, 2)
    SELECT technology_id, vulnerability_id, CASE WHEN expired THEN 'withdrawn' WHEN NOT fits THEN 'not_applicable' WHEN applies IS NOT NULL THEN 'applicable' WHEN un IS NOT NULL AND version IS NULL THEN 'unknown' WHEN un IS NOT NULL THEN 'review_required' ELSE 'not_applicable' END AS state,
        least(confidence, CASE WHEN expired THEN 0.0 WHEN NOT fits THEN 0.75 WHEN applies IS NOT NULL THEN 0.95 WHEN un IS NOT NULL THEN 0.55 ELSE 0.9 END::double) AS confidence, CASE WHEN NOT expired THEN coalesce(applies, un) END AS matched_range FROM g""")
def assess_applicability(spark, sf_dir):
    return applicability.assess(view(spark, sf_dir, "v_technology"), view(spark, sf_dir, "v_range"))


@registered(f"""WITH k AS (SELECT technology_id, vendor, product, version, {_key('version')} AS vk FROM v_technology WHERE version IS NOT NULL)
    SELECT technology_id, rank() OVER (PARTITION BY vendor, product ORDER BY vk DESC) AS rank FROM k""")
def version_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "v_technology").filter("version is not null").withColumn("vk", applicability.version_key("version"))
    return rows.select("technology_id", F.rank().over(Window.partitionBy("vendor", "product").orderBy(F.col("vk").desc())).alias("rank"))


@registered("WITH t AS (SELECT * FROM v_outcome ORDER BY score DESC, outcome_id LIMIT 50) SELECT avg(accepted::int)::double AS precision_at_k, count(*) AS n FROM t")
def precision_at_k(spark, sf_dir):
    return metrics.precision_at(view(spark, sf_dir, "v_outcome"), 50)


@registered("SELECT avg(accepted::int) AS acceptance_rate, avg(false_positive::int) AS false_positive_rate, avg(latency) AS mean_latency, sum(cost::decimal(20,2))::double / nullif(count(*) FILTER (accepted), 0) AS cost_per_accepted FROM v_outcome")
def outcome_metrics(spark, sf_dir):
    return metrics.outcome_metrics(view(spark, sf_dir, "v_outcome"))


@registered("""WITH p AS (SELECT source_id, count(*) AS events, sum(records) AS amount FROM v_run GROUP BY 1)
    SELECT source_id, events, amount, sum(events) OVER () - events AS events_without, sum(amount) OVER () - amount AS amount_without FROM p""")
def source_ablation(spark, sf_dir):
    return metrics.ablation(view(spark, sf_dir, "v_run"), "source_id", "records")


@registered(f"""SELECT user_id AS source_id, count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
    count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'error' AND ts > {AS_OF} - to_days(1)) AS recent_errors, min(ts) FILTER (event_type = 'error') AS oldest_error, sum(cast(floor(value) AS bigint)) AS volume, max(ts) AS last_run,
    cast(floor((epoch_us({AS_OF}) - epoch_us(max(ts))) / 1000000.0::double) AS bigint) AS lag_seconds FROM events GROUP BY 1""")
def collection_metrics(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_type", F.col("ts").alias("run_at"), F.floor("value").alias("records"))
    return metrics.collection_metrics(jobs, "source_id", as_of())


@registered("WITH t AS (SELECT user_id AS source_id, sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 1 END) AS total FROM events GROUP BY 1) SELECT source_id, total, total::double / max(total) OVER () AS score FROM t")
def value_scores(spark, sf_dir):
    return metrics.value_scores(table(spark, sf_dir, "events").withColumnRenamed("user_id", "source_id"), "source_id")


@registered("SELECT source, avg((coalesce(trim(text), '') <> '')::int)::double AS text, avg((coalesce(trim(lang), '') <> '')::int)::double AS lang FROM documents GROUP BY 1")
def field_population(spark, sf_dir):
    return metrics.field_population(table(spark, sf_dir, "documents"), "source", ["text", "lang"])


def quality_states(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("run_at"), "event_id", F.floor("value").alias("records"), F.when(F.col("event_id") % 23 == 0, 0.2).otherwise(0.9).alias("population"), F.concat(F.lit("f"), F.expr("event_id % 37 div 36")).alias("fingerprint"))
    return metrics.quality_states(runs, "source_id", ["run_at", "event_id"])


QUERIES["quality_states"] = quality_states
ORACLE_SQL["quality_states"] = """WITH RECURSIVE o AS (SELECT user_id AS s, cast(floor(value) AS double) AS x, CASE WHEN event_id % 23 = 0 THEN 0.2::double ELSE 0.9::double END AS p, event_id % 37 // 36 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT DISTINCT s, 0::bigint AS i, 0 AS n, NULL::double AS level, NULL::double AS field, [-1::bigint] AS known, 0 AS v, 0 AS fd, 0 AS sc, 0 AS rej FROM o
        UNION ALL
        SELECT s, i, CASE WHEN t THEN n + 1 ELSE n END, CASE WHEN t THEN CASE WHEN level IS NULL THEN x ELSE 0.75::double * level + 0.25::double * x END ELSE level END,
            CASE WHEN t THEN CASE WHEN field IS NULL THEN p ELSE 0.75::double * field + 0.25::double * p END ELSE field END, CASE WHEN n < 3 THEN list_append(known, f) ELSE known END, v + va::int, fd + fa::int, sc + sa::int, rej + (NOT t)::int
        FROM (SELECT *, n < 3 OR NOT (va OR fa OR sa) AS t FROM (
            SELECT w.s, o.i, w.n, w.level, w.field, w.known, w.v, w.fd, w.sc, w.rej, o.x, o.p, o.f, n >= 3 AND CASE WHEN level = 0 THEN x > 0 ELSE x < level * 0.2::double OR x > level * 5.0::double END AS va,
                n >= 3 AND field >= 0.8::double AND p < field - 0.4::double AS fa, n >= 3 AND NOT list_contains(known, f) AS sa
            FROM w JOIN o ON o.s = w.s AND o.i = w.i + 1)))
    SELECT s AS source_id, i AS runs, n AS samples, level, v AS volume_anomalies, fd AS field_anomalies, sc AS schema_drifts, rej AS rejected FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY i DESC) = 1"""


@registered("""WITH i AS (SELECT user_id, event_type IN ('error', 'signup') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'signup') ORDER BY ts, event_id) AS island FROM events),
    r AS (SELECT user_id, island, count(*) AS length FROM i WHERE failed GROUP BY ALL) SELECT user_id, max(length) AS longest, sum(length // 3)::bigint AS opened FROM r GROUP BY user_id""")
def circuit_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("error", "signup").alias("failed"))
    return metrics.circuit_states(rows, "user_id", ["ts", "event_id"], 3)
