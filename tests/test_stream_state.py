import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from evistrata.operators import reconcile
from evistrata.operators.revisions import RevisionSpec
from evistrata.plans.bindings import AS_OF, AS_OF_SHIP, for_spark, view
from evistrata.streaming import state

SF = "/root/testdata/sf0.001"


def at(text=AS_OF):
    return F.expr(for_spark(text))


SELF_FREE = RevisionSpec(supersedes="supersedes_record_key", ignore_self=True)
FROM_ALL = RevisionSpec(supersedes="supersedes_record_key", from_all=True)
FAMILIES = {
    "incidents": ("v_claim", state.Family("incident_key", lambda r, t: reconcile.reconcile_incidents(r))),
    "changes": ("v_change", state.Family("event_key", lambda r, t: reconcile.reconcile_changes(r, at()), reconcile.CHANGES)),
    "changes from all": ("v_change", state.Family("event_key", lambda r, t: reconcile.reconcile_changes(r, at(), FROM_ALL), FROM_ALL)),
    "relationships": ("v_relationship", state.Family("relationship_key", lambda r, t: reconcile.reconcile_relationships(r, at(AS_OF_SHIP), ("supplier",)), reconcile.CHANGES)),
    "indicators": ("v_indicator", state.Family("indicator_key", lambda r, t: reconcile.reconcile_indicators(r))),
    "assets": ("v_change", state.Family("asset_key", lambda r, t: reconcile.reconcile_assets(r, at(), SELF_FREE), SELF_FREE, carried={"history_count": ("count", ""), "first_seen_at": ("min", "published_at")})),
}


def as_rows(df):
    return sorted((repr(tuple(sorted(v) if isinstance(v, list) else v for v in r)) for r in df.collect()))


def own_records(rows, key):
    """Records that are named within their entity, as stored statements are."""
    named = {c: F.when(F.col(c).isNotNull(), F.concat_ws("/", F.col(key).cast("string"), c)) for c in ("source_record_key", "supersedes_record_key") if c in rows.columns}
    return rows.withColumns(named)


@pytest.mark.parametrize("name", FAMILIES)
def test_after_every_batch_the_projection_is_that_of_the_batch_query(spark, tmp_path, name):
    source, family = FAMILIES[name]
    rows = own_records(view(spark, SF, source), family.key)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for i in range(2):  # revisions of one record come in both batches, in no order
        part = rows.filter(F.pmod(F.xxhash64("snapshot_id"), F.lit(2)) == i)
        part.unionByName(rows.limit(20)).coalesce(1).write.mode("append").parquet(feed)  # twenty statements come again
        state.follow(spark.readStream.schema(rows.schema).parquet(feed), family, out, str(tmp_path / "state")).awaitTermination(120)
        so_far = spark.read.schema(rows.schema).parquet(feed).dropDuplicates(["snapshot_id"])
        assert as_rows(state.current(spark, out, family.key)) == as_rows(family.reconcile(so_far, None).select(*state.current(spark, out, family.key).columns))
        assert spark.read.parquet(f"{out}/history").count() == so_far.count()
    touched = spark.read.parquet(f"{out}/projection/version=1").count()
    assert touched == rows.filter(F.pmod(F.xxhash64("snapshot_id"), F.lit(2)) == 1).select(family.key).distinct().count()


ROW = "snapshot_id long, event_key long, source_id string, source_record_key string, supersedes_record_key string, modified_at timestamp_ntz, published_at timestamp_ntz, expires_at timestamp_ntz, confidence double, active boolean, historical_only boolean, claim_type string, event_type string, title string, organization_id long, link_status string, corroboration_key string"


def claim(i, event, record, supersedes=None, expires=None):
    t = dt.datetime(2024, 1, i, 1, 2, 3, 456789)
    return (i, event, "s", record, supersedes, t, t, expires, 0.1 + 0.2, True, False, "report", "x", 'ti"tle', None, "candidate", None)


def run(spark, tmp_path, rows, family, **trigger):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return state.follow(spark.readStream.schema(spark.createDataFrame([], ROW).schema).parquet(str(tmp_path / "feed")), family, str(tmp_path / "out"), str(tmp_path / "state"), **trigger)


def test_entities_vanish_and_come_back(spark, tmp_path):
    family = FAMILIES["changes"][1]
    now = lambda: [(r.event_key, r.claim_count) for r in state.current(spark, str(tmp_path / "out"), "event_key").orderBy("event_key").collect()]
    run(spark, tmp_path, [claim(1, 7, "a"), claim(2, 8, "b")], family).awaitTermination(60)
    assert now() == [(7, 1), (8, 1)]
    run(spark, tmp_path, [claim(3, 7, "a", supersedes="a")], family).awaitTermination(60)  # nothing is left of 7
    assert now() == [(8, 1)]
    state.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"), "event_key")
    assert [r.event_key for r in state.current(spark, str(tmp_path / "small"), "event_key").collect()] == [8]
    run(spark, tmp_path, [claim(4, 7, "c"), claim(1, 7, "a")], family).awaitTermination(60)
    assert now() == [(7, 1), (8, 1)]
    # a batch that is run again overwrites what it wrote
    told = spark.read.parquet(str(tmp_path / "out/changes/batch=1"))
    again = state.versions(told, family, family.reconcile(spark.createDataFrame([claim(3, 7, "a", supersedes="a")], ROW), None))
    assert [(r.event_key, r.deleted) for r in again.collect()] == [(7, True)]


def test_entities_are_reconciled_again_when_a_time_has_come(spark, tmp_path):
    soon = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(seconds=15)
    family = state.Family("event_key", lambda r, t: reconcile.reconcile_changes(r, t.cast("timestamp_ntz")), reconcile.CHANGES, expires=("expires_at",))
    query = run(spark, tmp_path, [claim(1, 7, "a", expires=soon), claim(2, 8, "b")], family, processingTime="1 second")
    seen, ends = [], time.time() + 90
    try:
        while time.time() < ends and (not seen or seen[-1] != {7: "stale", 8: "reported"}):
            time.sleep(1)
            try:
                found = {r.event_key: r.status for r in state.current(spark, str(tmp_path / "out"), "event_key").collect()}
            except Exception:  # nothing is written yet
                continue
            if found and (not seen or seen[-1] != found):
                seen.append(found)
    finally:
        query.stop()
    assert seen == [{7: "reported", 8: "reported"}, {7: "stale", 8: "reported"}]
