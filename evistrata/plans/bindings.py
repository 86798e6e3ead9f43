"""Views that give the generic tables the shape of evidence data, as one SQL text for both engines.

Texts are written for DuckDB; for Spark a few forms are rewritten. Tables are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
AS_OF_SHIP = "TIMESTAMP '1999-01-01 00:00:00'"

VIEWS: dict[str, str] = {
    "v_claim": """
        SELECT event_id AS snapshot_id, event_id // 6 AS incident_key, 's' || (event_id % 3) AS source_id, (event_id // 6) || ':' || (event_id % 3) AS source_record_key,
               ts AS modified_at, ts AS published_at, least(1.0::double, value / 250.0::double) AS confidence, event_id % 11 <> 0 AS active, event_id % 13 = 0 AS historical_only,
               CASE event_type WHEN 'purchase' THEN 'official_confirmation' WHEN 'view' THEN 'report' WHEN 'click' THEN 'attacker_allegation' WHEN 'error' THEN 'denial' ELSE 'retraction' END AS claim_type,
               CASE event_id % 5 WHEN 0 THEN 'malware' WHEN 1 THEN 'ransomware' WHEN 2 THEN 'data_breach' WHEN 3 THEN 'unknown' ELSE 'extortion' END AS incident_type,
               'incident ' || (event_id % 17) AS title, 'summary ' || event_id AS summary, 'org ' || (user_id % 40) AS organization_name,
               CASE WHEN event_id % 4 = 0 THEN user_id % 5 END AS organization_id,
               CASE WHEN event_id % 4 = 0 THEN 'exact' WHEN event_id % 4 = 1 THEN 'candidate' WHEN event_id % 4 = 2 THEN 'unresolved' ELSE 'rejected' END AS link_status,
               CASE WHEN event_id % 7 <> 0 THEN 'k' || (user_id % 9) END AS independence_key
        FROM {events}""",
    "v_change": """
        SELECT event_id AS snapshot_id, event_id // 6 AS event_key, 's' || (event_id % 3 // 2) AS source_id, (event_id // 6) || ':' || (event_id % 3) AS source_record_key,
               CASE WHEN event_id % 17 = 0 THEN (event_id // 6) || ':' || ((event_id + 1) % 3) END AS supersedes_record_key,
               ts AS modified_at, ts AS published_at, CASE WHEN event_id % 3 <> 0 THEN ts + to_days(cast(event_id % 40 AS int)) END AS expires_at, least(1.0::double, value / 250.0::double) AS confidence,
               event_id % 11 <> 0 AS active, event_id % 13 = 0 AS historical_only,
               CASE event_id % 7 WHEN 0 THEN 'official_announcement' WHEN 1 THEN 'report' WHEN 2 THEN 'speculation' WHEN 3 THEN 'dispute' WHEN 4 THEN 'correction' WHEN 5 THEN 'retraction' ELSE 'report' END AS claim_type,
               event_type, 'change ' || (event_id % 17) AS title, CASE WHEN event_id % 4 = 0 THEN user_id % 5 END AS organization_id,
               CASE WHEN event_id % 4 = 0 THEN 'exact' WHEN event_id % 4 = 1 THEN 'candidate' ELSE 'unresolved' END AS link_status, 'k' || (user_id % 9) AS corroboration_key,
               event_id % 19 = 0 AS attribution_risk, ts AS valid_from, CASE WHEN event_id % 3 = 1 THEN ts + to_days(cast(event_id % 15 AS int)) END AS valid_until,
               event_id // 6 AS asset_key, event_id // 6 AS node_key
        FROM {events}""",
    "v_raw": """
        SELECT event_id, CASE WHEN event_id % 29 <> 0 THEN user_id END AS record_key, ts AS effective_at, ts AS collected_at, value, event_type,
               CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'signup' THEN 'retraction' WHEN 'click' THEN 'correction' ELSE 'upsert' END AS action
        FROM {events}""",
    "v_indicator": """
        SELECT event_id AS snapshot_id, event_id // 8 AS indicator_key, 's' || (event_id % 4) AS source_id, (event_id // 8) || ':' || (event_id % 4) AS source_record_key, event_id % 3 AS source_precedence,
               ts AS modified_at, ts - to_days(cast(event_id % 9 AS int)) AS first_seen_at, ts + to_days(cast(event_id % 5 AS int)) AS last_seen_at, event_id % 11 <> 0 AS active, event_id % 2 = 0 AS historical_only,
               CASE event_type WHEN 'purchase' THEN 'malicious' WHEN 'view' THEN 'suspicious' WHEN 'click' THEN 'benign' WHEN 'error' THEN 'shared_infrastructure' ELSE 'unknown' END AS state,
               'k' || (user_id % 6) AS independence_key, least(1.0::double, value / 250.0::double) AS relation_confidence, 't' || (user_id % 3) AS relation_type, 'n' || (event_id % 2) AS target_key
        FROM {events}""",
    "v_relationship": """
        SELECT (o_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 10000 + l_suppkey AS snapshot_id, (l_suppkey % 40) || '>' || (o_custkey % 60) AS relationship_key, 's' || (l_suppkey % 3) AS source_id,
               l_orderkey || ':' || l_linenumber AS source_record_key, CASE WHEN l_orderkey % 23 = 0 THEN l_orderkey || ':' || (l_linenumber % 3 + 1) END AS supersedes_record_key,
               CASE l_returnflag WHEN 'R' THEN 'supplier' WHEN 'A' THEN 'partner' ELSE 'supplier' END AS role,
               CASE WHEN l_orderkey % 41 = 0 THEN 'dispute' WHEN l_orderkey % 43 = 0 THEN 'correction' WHEN l_orderkey % 47 = 0 THEN 'retraction' ELSE 'assertion' END AS claim_type,
               CASE l_linenumber % 5 WHEN 0 THEN 'contracted' WHEN 1 THEN 'claimed' WHEN 2 THEN 'observed' WHEN 3 THEN 'inferred' ELSE 'historical' END AS evidence_class,
               l_shipdate AS valid_from, l_shipdate + to_days(cast(l_quantity * 10 AS int)) AS valid_until, l_shipdate + to_days(365) AS renewal_at,
               CASE WHEN l_partkey % 3 = 0 THEN l_shipdate + to_days(200) END AS expires_at, l_shipdate AS modified_at, l_shipdate AS published_at, l_shipdate AS observed_at,
               1.0::double - l_discount AS confidence, l_partkey % 9 <> 0 AS active, l_partkey % 5 = 0 AS historical_only, CASE WHEN l_partkey % 2 = 0 THEN 'k' || (l_partkey % 7) END AS independence_key,
               l_suppkey % 6 AS source_organization_id, o_custkey % 6 AS target_organization_id, CASE WHEN l_partkey % 2 = 0 THEN 'exact' ELSE 'candidate' END AS source_link_status,
               CASE WHEN l_partkey % 3 = 0 THEN 'exact' ELSE 'unresolved' END AS target_link_status
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "v_org": "SELECT c_custkey AS organization_id, 'Acme ' || (c_custkey % 400) || ' SAS' AS name, c_nationkey AS postal_code, c_mktsegment AS segment, c_acctbal AS balance FROM {customer}",
    "v_identity": "SELECT s_suppkey AS identity_id, 'ACME-' || s_suppkey AS name, s_nationkey AS postal_code, s_acctbal AS balance FROM {supplier}",
    "v_edge": "SELECT 'P' || event_id AS a, 'S' || (event_id * event_id % 997) AS b FROM {events} UNION SELECT 'S' || (event_id * event_id % 997) AS a, 'T' || (event_id * event_id % 997 % 60) AS b FROM {events}",
    "v_technology": "SELECT p_partkey AS technology_id, p_brand AS vendor, 'p' || (p_partkey % 7) AS product, CASE WHEN p_partkey % 13 <> 0 THEN p_size || '.' || (p_partkey % 20) || CASE WHEN p_partkey % 6 = 0 THEN 'rc1' ELSE '' END END AS version, 0.5::double + (p_partkey % 50) / 100.0::double AS confidence, p_partkey % 17 = 0 AS expired, CASE WHEN p_partkey % 4 = 0 THEN 'linux' ELSE 'windows' END AS platform FROM {part}",
    "v_range": "SELECT p_partkey AS range_id, p_partkey % 30 AS vulnerability_id, p_brand AS vendor, 'p' || (p_partkey % 7) AS product, CASE WHEN p_partkey % 3 = 0 THEN 'linux' END AS platform, (p_size % 20) || '.2' AS introduced, (p_size % 20 + 12) || '.0' AS fixed, p_partkey % 4 <> 0 AS introduced_inclusive, p_partkey % 5 = 0 AS fixed_inclusive, p_partkey % 11 = 0 AS backported_fix, CASE WHEN p_partkey % 9 = 0 THEN 'rpm' ELSE 'semver' END AS scheme FROM {part}",
    "v_signal": """
        SELECT event_id AS signal_id, user_id % 60 AS organization_id, 'e' || (event_id // 2) AS evidence_id, 's' || (event_id % 5) AS corroboration_key, ts - to_days(cast(event_id % 500 AS int)) AS effective_at,
               CASE WHEN event_id % 3 <> 0 THEN ts + to_days(cast(event_id % 40 AS int)) END AS expires_at, least(1.0::double, value / 200.0::double) AS confidence,
               CASE event_type WHEN 'error' THEN 'contradicting' WHEN 'signup' THEN 'negative' ELSE 'supporting' END AS polarity,
               CASE event_id % 4 WHEN 0 THEN 'public_tender' WHEN 1 THEN 'job_posting' WHEN 2 THEN 'research_discovery' ELSE 'technology_change' END AS signal_type,
               event_id % 10 = 0 AS is_explicit, event_id % 6 = 0 AS historical_only,
               CASE event_id % 3 WHEN 0 THEN ['incident_urgency', 'external_exposure'] WHEN 1 THEN ['explicit_procurement'] ELSE ['capability_build'] END AS hypothesis_classes,
               CASE event_id % 4 WHEN 0 THEN ['siem', 'soc'] WHEN 1 THEN ['iam'] WHEN 2 THEN ['audit'] ELSE ['siem'] END AS service_families,
               CASE event_id % 5 WHEN 0 THEN 'Managed SIEM renewal' WHEN 1 THEN 'SOC analyst wanted' WHEN 2 THEN 'Splunk engineer' WHEN 3 THEN 'Office chairs' ELSE 'xdr and log management' END AS title,
               CASE event_id % 7 WHEN 0 THEN 'needs log management' WHEN 1 THEN 'security operations team' ELSE 'note' END AS summary, CASE WHEN event_id % 9 = 0 THEN ['mdr'] ELSE ['none'] END AS matched_terms
        FROM {events}""",
    "v_vulnerability": """
        SELECT event_id AS snapshot_id, 's' || (event_id // 2 % 4) AS source, 'r' || (event_id // 2) AS source_record_key, event_id // 2 % 4 AS source_precedence,
               CASE WHEN event_id % 3 = 0 THEN 'CVE-2024-' || (event_id // 7) ELSE 'GHSA-' || (event_id // 5) END AS canonical_id, CASE WHEN event_id % 6 = 0 THEN 'GHSA-' || (event_id // 5) END AS alias,
               CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'title ' || event_id END AS title, CASE WHEN event_id % 4 = 0 THEN 'text ' || (user_id % 30) END AS description,
               CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'withdrawn' WHEN 'click' THEN 'updated' ELSE 'published' END AS status, ts AS modified_at, ts - to_days(cast(event_id % 30 AS int)) AS published_at,
               'CWE-' || (user_id % 20) AS cwe, CASE WHEN event_id % 2 = 0 THEN 'epss' ELSE 'cvss_v3' END AS score_system, (event_id % 100) / 10.0::double AS score_value, ts AS assessed_at,
               'eco' || (user_id % 2) AS ecosystem, CASE WHEN event_id % 2 = 0 THEN 'Prod' ELSE 'prod' END || (user_id % 5) AS product, '1.' || (event_id % 3) AS introduced, '2.' || (event_id % 2) AS fixed,
               CASE event_id % 3 WHEN 0 THEN 'proof_of_concept' ELSE 'known_exploited' END AS kind, event_id % 5 = 0 AS kind_active, least(1.0::double, value / 250.0::double) AS kind_confidence
        FROM {events}""",
    "v_person": """
        SELECT event_id AS snapshot_id, 'p' || (user_id % 200) AS person_key, 'Name ' || (event_id % 40) AS display_name, 's' || (event_id % 3) AS source_id, least(1.0::double, value / 250.0::double) AS confidence,
               event_id % 31 = 0 AS suppressed, event_id % 37 = 0 AS deleted, ts AS observed_at, ts + to_days(cast(event_id % 60 AS int)) AS retention_until FROM {events}""",
    "v_outcome": "SELECT doc_id AS outcome_id, least(100.0::double, n_chars / 50.0::double) AS score, quality = 1 AND toxic = 0 AS accepted, toxic = 1 AS false_positive, (doc_id % 7) * 1.5::double AS cost, n_chars AS latency FROM {labels} JOIN {documents} USING (doc_id)",
    "v_run": "SELECT user_id AS source_id, ts AS run_at, event_id, cast(floor(value) AS bigint) AS records, 'f' || (event_id % 37 // 36) AS fingerprint, CASE WHEN event_id % 23 = 0 THEN 0.2::double ELSE 0.9::double END AS population FROM {events}",
    "v_contract": "SELECT o_orderkey AS contract_id, o_custkey AS buyer_id, c_name AS buyer_name, n_name AS country, o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN 'ended' WHEN 'O' THEN 'open' ELSE 'planned' END AS status, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_days(cast(o_orderkey % 700 AS int)) END AS renewal_at, o_orderdate AS published_at, o_orderpriority AS family FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
}

#: Tables whose rows a task hashes for the join of a view, so that the rows of the larger table are not sorted.
HASHED = {"v_relationship": ("orders",)}

_TO_SPARK = (
    (r" // ", " div "), (r"\bto_days\((cast\((?:[^()]|\([^()]*\))*\)|\d+)\)", r"make_dt_interval(\1)"), (r"([\d.]+)::double", r"\1D"),
    (r"\bTIMESTAMP '", "TIMESTAMP_NTZ '"), (r"\['([^\]]*)'\]", r"array('\1')"), (r"\[\]::VARCHAR\[\]", "cast(array() as array<string>)"),
)


def for_spark(text: str) -> str:
    for pattern, to in _TO_SPARK:
        text = re.sub(pattern, to, text)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``; only the columns that are used are read."""
    text = for_spark(VIEWS[name])
    rows = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **{t: d.hint("shuffle_hash") if t in HASHED.get(name, ()) else d for t, d in rows.items()})


def sql(text: str) -> str:
    """DuckDB SQL with the views that ``text`` names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    body = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    head, rest = ("WITH RECURSIVE ", text[len("WITH RECURSIVE ") :]) if text.startswith("WITH RECURSIVE ") else ("WITH ", text[len("WITH ") :] if text.startswith("WITH ") else None)
    if not body:
        return text
    return f"{head}{body}, {rest}" if rest is not None else f"WITH {body} {text}"
