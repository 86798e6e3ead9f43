"""Rules with the values that they must give, worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from evistrata.operators import governance, graph_loaders, matching
from evistrata.streaming import jobs

T = dt.datetime(2024, 3, 1)


def test_names_lose_their_marks(spark):
    names = {"Škoda Plzeň SA": "SKODA PLZEN", "ŐRSÉG GmbH": "ORSEG", "Société Générale": "SOCIETE GENERALE", "Nguyễn Ltd": "NGUYEN", "Ｆｕｌｌ Company": "FULL", "Straße": "STRASSE" if "ß".upper() == "SS" else "", "": ""}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r.n: r.x for r in d.select("n", matching.legal_name("n").alias("x")).collect()}
    assert {k: v for k, v in found.items() if k != "Straße"} == {k: v for k, v in names.items() if k != "Straße"}


def test_review_states_in_their_order(spark):
    cases = {"a": ["unreviewed"], "b": ["auto_confirmed", "unreviewed"], "c": ["rejected", "confirmed"], "d": ["rejected", "rejected"], "e": ["confirmed", "review_required", "rejected"], "f": ["rejected", "unreviewed"], "g": ["rejected", "auto_confirmed"]}
    d = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "edge_key string, review_state string")
    assert {r.edge_key: r.review_state for r in graph_loaders.review_states(d).collect()} == {"a": "unreviewed", "b": "auto_confirmed", "c": "confirmed", "d": "rejected", "e": "review_required", "f": "unreviewed", "g": "auto_confirmed"}


def test_what_bars_a_source_comes_before_its_age(spark):
    rows = [
        (1, None, False, True, None, 5, 0.0, 0.0, None), (2, T, True, True, T, 0, 0.0, 0.0, None), (3, T, True, True, None, 0, 9.0, 9.0, 10.0), (4, T, True, True, None, None, 2.0, 9.0, 10.0), (5, T, True, True, None, 1, 1.0, 9.0, 10.0),
        (6, T - dt.timedelta(hours=1), False, True, None, 1, 0.0, 99.0, 10.0), (7, T - dt.timedelta(hours=3), False, False, None, 1, 0.0, 0.0, None), (8, T - dt.timedelta(hours=5), False, True, None, 1, 0.0, 0.0, None),
    ]
    d = spark.createDataFrame(rows, "source_id int, last_success_at timestamp_ntz, historical_only boolean, executable boolean, authorization_expires_at timestamp_ntz, quota_remaining int, next_cost double, cost_used double, cost_limit double").withColumn("max_age", F.lit(4 * 3600))
    found = {r.source_id: (r.freshness, r.may_run) for r in governance.source_freshness(d, F.lit(T).cast("timestamp_ntz"), spark.createDataFrame([(1,), (9,)], "source_id int")).collect()}
    assert found == {
        1: ("stale_refresh_queued", True), 2: ("authorization_expired", False), 3: ("quota_exhausted", False), 4: ("cost_budget_exhausted", False), 5: ("historical_only", True),
        6: ("fresh", True), 7: ("aging", False), 8: ("stale_refresh_queued", True), 9: (None, True),
    }


def test_partitions_fail_and_are_claimed_by_age(spark):
    rows = [("a", 1, 0, 1, "running", 1, 3, T), ("b", 1, 9, 10, "pending", 0, 3, T), ("c", 1, 5, 6, "failed", 2, 3, T + dt.timedelta(1)), ("d", 1, 1, 2, "failed", 3, 3, T - dt.timedelta(1)), ("e", 2, 1, 2, "running", 3, 3, T)]
    d = spark.createDataFrame(rows, "partition_key string, source_id int, lower int, upper int, state string, attempts int, max_attempts int, created_at timestamp_ntz")
    assert [(r.source_id, r.partition_key) for r in jobs.claim_partitions(d, F.lit(T)).collect()] == [(1, "b")]
    told = spark.createDataFrame([("a", False, False), ("e", False, True), ("b", True, True)], "partition_key string, succeeded boolean, retryable boolean")
    assert {r.partition_key: (r.state, r.attempts) for r in jobs.end_partitions(d, told).collect()} == {"a": ("failed", 3), "e": ("failed", 3), "b": ("pending", 0), "c": ("failed", 2), "d": ("failed", 3)}


def claim(**values):
    base = {"incident_key": 1, "source_record_key": "r", "claim_type": "report", "title": "t", "organization_id": 5, "link_status": "exact", "active": True, "historical_only": False, "modified_at": T, "confidence": 0.5}
    return base | values


def test_incident_edges_stay_active_where_claims_dispute(spark):
    rows = [claim(), claim(incident_key=2, claim_type="denial"), claim(incident_key=3, claim_type="retraction"), claim(incident_key=4, historical_only=True), claim(incident_key=5, link_status="candidate"), claim(incident_key=6, organization_id=None)]
    schema = "incident_key long, source_record_key string, claim_type string, title string, organization_id long, link_status string, active boolean, historical_only boolean, modified_at timestamp_ntz, confidence double"
    nodes, edges = graph_loaders.incidents(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert {r.node_key: r.active for r in nodes.collect()} == {"incident:1": True, "incident:2": False, "incident:3": False, "incident:4": False, "incident:5": True, "incident:6": True}
    assert [(r.edge_key, r.edge_type, r.claim_type, r.review_state, r.active) for r in edges.orderBy("edge_key").collect()] == [
        ("incident-organization:1:5", "incident_involves", "assertion", "confirmed", True), ("incident-organization:2:5", "incident_involves", "dispute", "confirmed", True),
        ("incident-organization:3:5", "incident_involves", "retraction", "confirmed", True), ("incident-organization:4:5", "incident_involves", "assertion", "confirmed", False),
    ]


def test_an_edge_is_never_left_without_a_statement_and_holds_in_its_time(spark):
    at = lambda h: T + dt.timedelta(hours=h)
    rows = [("e", "r1", None, at(1), None, True, "assertion"), ("e", "r2", "r1", at(2), at(5), True, "assertion"), ("f", "r1", "r1", at(1), None, True, "assertion"), ("g", "r1", None, at(1), None, True, "retraction"), ("h", "r9", None, at(9), None, True, "assertion")]
    edges = spark.createDataFrame(rows, "edge_key string, source_record_key string, supersedes_record_key string, observed_at timestamp_ntz, valid_until timestamp_ntz, active boolean, claim_type string")
    edges = edges.selectExpr("edge_key", "'n' as source_node_key", "edge_key as target_node_key", "'k' as edge_type", "'m' as source_module", "source_record_key", "null as evidence_class", "claim_type", "'confirmed' as review_state", "observed_at", "cast(null as timestamp_ntz) valid_from", "valid_until", "cast(null as timestamp_ntz) expires_at", "0.5D as confidence", "active", "supersedes_record_key")
    nodes = spark.createDataFrame([("n", "x", "N", "m", "r", None, T, None, None, 0.5, True)], "node_key string, node_type string, display_name string, source_module string, source_record_key string, organization_id string, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, confidence double, active boolean")
    shown = lambda h: {(r.edge_key, r.statements) for r in graph_loaders.node_detail(nodes, edges, "n", F.lit(at(h)).cast("timestamp_ntz"))[2].collect()}
    assert shown(1) == {("e", 1), ("f", 1)} and shown(3) == {("e", 1), ("f", 1)} and shown(6) == {("f", 1)} and shown(10) == {("f", 1), ("h", 1)}
    node, snapshots, everything = graph_loaders.node_detail(nodes, edges, "n")
    assert node.first().organization_id is None and snapshots.count() == 1 and everything.count() == 4
