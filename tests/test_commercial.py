from pyspark.sql import functions as F

from evistrata.operators import commercial
from evistrata.plans.bindings import AS_OF, for_spark, view

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_batches_give_what_one_batch_gives_and_analysts_keep_their_say(spark, tmp_path):
    now = F.expr(for_spark(AS_OF))
    signals = view(spark, SF, "v_signal").filter("organization_id < 12")
    of = lambda part: (part.select("organization_id").distinct().selectExpr("organization_id", "'n' as name", "cast(null as array<string>) registration_ids", "cast(null as timestamp_ntz) updated_at"), signals.groupBy("evidence_id", "organization_id").agg(F.max("effective_at").alias("collected_at")).join(part, ["evidence_id", "organization_id"], "left_semi"), part)
    once = commercial.store(spark, str(tmp_path / "once"))
    commercial.persist(once, "all", *of(signals), now)
    twice = commercial.store(spark, str(tmp_path / "twice"))
    commercial.persist(twice, "a", *of(signals.filter("signal_id % 3 = 0")), now)
    commercial.persist(twice, "b", *of(signals.filter("signal_id % 3 > 0")), now)
    for name in commercial.TABLES:
        assert rows(twice.read(name)) == rows(once.read(name)), name
    version = twice.manifest()["version"]
    assert commercial.persist(twice, "b", *of(signals), now) == version  # run again

    # an analyst snoozes one opportunity and overrides a component; a signal of another organization leaves both alone
    some = twice.read("opportunities").orderBy("organization_id").first().organization_id
    snoozed = twice.read("opportunities").filter(F.col("organization_id") == some).withColumns({"state": F.lit("snoozed"), "snoozed_until": now + F.make_dt_interval(F.lit(5))})
    own = twice.read("components").filter((F.col("organization_id") == some) & (F.col("rule") == "signal-freshness")).withColumns({"value": F.lit(0.123), "overridden": F.lit(True)})
    twice.publish("review", [("opportunities", snoozed), ("components", own)])
    before = len(twice.manifest()["tables"]["opportunities"])
    commercial.persist(twice, "again", *of(signals.filter(F.col("organization_id") == some).limit(1)), now)
    kept = twice.read("opportunities").filter(F.col("organization_id") == some).first()
    part = twice.read("components").filter((F.col("organization_id") == some) & (F.col("rule") == "signal-freshness")).first()
    assert kept.state == "snoozed" and part.value == 0.123 and part.overridden and part.original_value is not None
    added = twice.manifest()["tables"]["opportunities"][before:]
    assert [r.organization_id for r in spark.read.parquet(added[0][0]).collect()] == [some]  # nothing else was scored
    # later the snooze has ended
    commercial.persist(twice, "later", *of(signals.filter(F.col("organization_id") == some).limit(1)), now + F.make_dt_interval(F.lit(6)))
    assert twice.read("opportunities").filter(F.col("organization_id") == some).first().state == "needs_review"
