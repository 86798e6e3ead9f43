"""Work that must not grow faster than the rows: equal rows are judged once, tables are read once."""

from pyspark.sql import functions as F

from evistrata.operators import applicability, governance, graph_loaders, lineage, reconcile
from evistrata.plans import graphs
from evistrata.streaming import state

TECHNOLOGIES = "technology_id long, vendor string, product string, version string, confidence double, expired boolean"
RANGES = "range_id long, vulnerability_id long, vendor string, product string, introduced string, fixed string, introduced_inclusive boolean, fixed_inclusive boolean, backported_fix boolean, scheme string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def alike(spark):
    """Copies of two technologies and of two ranges that hold one of them; a null version, a null vendor."""
    t = [(i, "v", "p", "1.5" if i % 2 else "9.0", i / 100, i == 5) for i in range(40)] + [(40, "v", "p", None, 0.5, False), (41, None, "p", "1.5", 0.5, False)]
    r = [(100 - i, i % 2, "v", "p", "1.0" if i % 2 else "v1.0", "2.0", True, False, False, "semver") for i in range(60)]
    return spark.createDataFrame(t, TECHNOLOGIES), spark.createDataFrame(r, RANGES)


def test_equal_ranges_meet_a_version_once(spark, monkeypatch):
    met, held = [], applicability.held
    monkeypatch.setattr(applicability, "held", lambda *args: met.append(held(*args)) or met[-1])
    got = {(x.technology_id, x.vulnerability_id): (x.state, x.confidence, x.matched_range) for x in applicability.assess(*alike(spark)).collect()}
    assert met[0].count() == 2  # one version that is held, two vulnerabilities; not sixty ranges
    first = {0: 42, 1: 41}
    want = {(i, v): ("withdrawn", 0.0, None) if i == 5 else ("applicable", i / 100, first[v]) if i % 2 else ("not_applicable", i / 100, None) for i in range(40) for v in (0, 1)}
    assert got == want | {(40, v): ("unknown", 0.5, first[v]) for v in (0, 1)}


def test_assessments_show_columns_of_technology_and_matched_range(spark):
    rows = applicability.assess(*alike(spark), keep=("version", "vendor"), told=("scheme", "fixed")).filter("technology_id in (4, 5, 7) and vulnerability_id = 1")
    assert {x.technology_id: (x.version, x.vendor, x.scheme, x.fixed) for x in rows.collect()} == {4: ("9.0", "v", None, None), 5: ("1.5", "v", None, None), 7: ("1.5", "v", "semver", "2.0")}


def test_a_detail_assesses_its_technology_only(spark, monkeypatch):
    from evistrata.plans import entities

    seen, assess = [], applicability.assess
    monkeypatch.setattr(applicability, "assess", lambda t, r, *more: seen.append((t.count(), r.select("vendor", "product").distinct().count())) or assess(t, r, *more))
    assert entities.applicability_detail(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [(1, 1)]


class Kept:
    """States of one entity in memory, each call counted."""

    def __init__(self):
        self.calls, self.maps, self.value = 0, {"latest": {}, "seen": {}}, None

    def getMapState(self, name, *_):
        return Asked(self, self.maps[name])

    def getValueState(self, *_):
        return Asked(self, None)


class Asked:
    def __init__(self, kept, rows):
        self.kept, self.rows = kept, rows

    def __getattribute__(self, name):
        if name not in ("kept", "rows"):
            self.kept.calls += 1
        return object.__getattribute__(self, name)

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def iterator(self):
        return iter(self.rows.items())

    def exists(self):
        return self.kept.value is not None

    def get(self):
        return self.kept.value

    def update(self, value):
        self.kept.value = value


def test_the_state_is_asked_a_few_times_for_an_entity(monkeypatch):
    from pyspark.sql import Row

    kept, told = Kept(), state.LatestStatements(["count"], None, None, False)
    told.init(kept)
    claim = lambda i, record: Row(record=record, statement=str(i), rank=f'{{"c0": {i}}}', due=[], folds='{"c0": null}', payload=f'{{"n": {i}}}')
    run = lambda rows: [(r.kind, r.payload, r.carried) for r in told.handleInputRows(("e",), iter(rows), None)]
    first = run([claim(i, "abc"[i % 3]) for i in (0, 3, 1, 4, 5, 2, 5)])
    assert sorted(r[1] for r in first if r[0] == "new") == [f'{{"n": {i}}}' for i in range(6)] and sorted(r[1:] for r in first if r[0] == "latest") == [(f'{{"n": {i}}}', "[6]") for i in (3, 4, 5)]
    assert kept.calls <= 5  # the history, three records, the history; 23 when each statement asked
    monkeypatch.setattr(state, "SEEN", 2)  # beyond it statements have keys of their own, and are known all the same
    for rows, new in (([5, 6, 9], [6, 9]), ([0, 3, 6, 9, 12], [12]), ([12, 0, 9, 15, 4], [15])):
        assert [r[1] for r in run([claim(i, "abc"[i % 3]) for i in rows]) if r[0] == "new"] == [f'{{"n": {i}}}' for i in new]
    assert sorted(r[1:] for r in run([claim(15, "a")]) if r[0] == "latest") == [(f'{{"n": {i}}}', "[10]") for i in (15, 4, 5)]


def test_only_signals_without_families_are_searched_and_once(spark):
    rows = [(1, ["a"], ["b"], "public_tender", "Managed SIEM", None), (2, [], ["b"], "public_tender", "Managed SIEM", None), (3, None, None, "job_posting", None, "xdr"), (4, [], [], "job_posting", None, None), (5, [], [], "note", "siem", "x"), (6, [], None, None, "siem", "x")]
    d = spark.createDataFrame([(*r, False, None, "s") for r in rows], "signal_id long, service_families array<string>, hypothesis_classes array<string>, signal_type string, title string, summary string, is_explicit boolean, independence_key string, source_id string")
    found = governance.map_signals(d)
    got = {r.signal_id: (r.service_families, r.is_explicit, r.hypothesis_classes) for r in found.collect()}
    soc = ["soc_siem_mdr_xdr_soar"]
    assert {i: g[:2] for i, g in got.items()} == {1: (["a"], False), 2: (soc, True), 3: (soc, False), 4: ([], False), 5: ([], False), 6: ([], False)}
    assert got[2][2] == list(governance.TENDER_CLASSES) and got[3][2] == list(governance.JOB_CLASSES) and got[6][2] is None
    assert plan_of(found.select("signal_id", "service_families", "is_explicit")).count("concat_ws") == 1  # 137 when each use of the text made it


def test_a_relationship_is_read_once_for_its_three_edges(spark):
    found = graphs.relationship_edges(spark, "/root/testdata/sf0.001")
    assert plan_of(found).count("Join ") == 1
    rows = spark.createDataFrame([("k", "r", "partner", "x", 1, None, "exact", None, True, True)], "relationship_key string, source_record_key string, role string, claim_type string, source_organization_id long, target_organization_id long, source_link_status string, target_link_status string, active boolean, historical_only boolean")
    edges = graph_loaders.relationships(rows.withColumns({"evidence_class": F.lit("observed"), "supersedes_record_key": F.lit("q")}))[1]
    assert {(e.edge_key, e.edge_type, e.review_state, e.source_record_key, e.supersedes_record_key, e.evidence_class, e.active) for e in edges.collect()} == {
        ("business-relationship:k", "partner_of", "confirmed", "r", "q", "observed", False), ("relationship-endpoint-binding:k:source:1", "identity_of", "confirmed", "r:source:identity", "q:source:identity", "endpoint_resolution", True)}


def test_the_graph_sorts_no_table_and_its_tasks_read_bounded_parts(spark):
    name, found = "spark.sql.adaptive.advisoryPartitionSizeInBytes", graphs.edge_review_states(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(name) == f"{lineage.JOINED_BYTES}b"  # 64 MB of packed keys were 1 GB in memory
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in physical
    for given, kept in (("4m", "4m"), ("2mb", "2mb"), ("1g", f"{lineage.JOINED_BYTES}b")):
        spark.conf.set(name, given)
        lineage.small_tasks(spark)
        assert spark.conf.get(name) == kept
    spark.conf.unset(name)


def test_references_meet_only_texts_that_several_hold(spark):
    rows = spark.createDataFrame([(1, "A", "Same  Co", [" X1", "U1"]), (2, "B", "same co ", ["x1", ""]), (3, "C", "Other", None)], "organization_id long, canonical_name string, legal_name string, registration_ids array<string>")
    edges = graph_loaders.organizations(rows.withColumns({"website_url": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")}))[1]
    assert sorted((e.edge_type, e.target_node_key, e.review_state) for e in edges.collect()) == [
        ("alias_of", "organization:1", "review_required"), ("alias_of", "organization:2", "review_required"), ("alias_of", "organization:3", "confirmed"),
        ("identifies", "organization:1", "confirmed"), ("identifies", "organization:1", "review_required"), ("identifies", "organization:2", "review_required")]
    assert plan_of(edges).count("Join LeftOuter") == 2  # of all texts and their counts before


def test_relationships_are_reconciled_once_for_a_page(spark, monkeypatch):
    from evistrata.plans import entities

    asked, reconciled = [], reconcile.reconcile_relationships
    monkeypatch.setattr(reconcile, "reconcile_relationships", lambda *args: asked.append(args) or reconciled(*args))
    assert len(entities.list_relationships(spark, "/root/testdata/sf0.001").columns) == 3 and len(asked) == 1
