import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evistrata.operators.publish import Conflict, Publication, Table, put_once
from evistrata.streaming.queue import JOB, Queue

PARTS = {n: Table("k long, v string", () if n == "log" else ("k",), buckets=4) for n in ("log", *"abcdefghij")}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def shown(pub):
    return {n: sorted((r.k, r.v) for r in pub.read(n).collect()) for n in PARTS}


def test_a_batch_that_stops_half_way_shows_nothing_and_then_all_once(spark, tmp_path):
    pub = Publication(spark, str(tmp_path), PARTS)
    assert all(v == [] for v in shown(pub).values())
    pub.publish("one", [("log", rows(spark, (1, "x"))), ("a", rows(spark, (1, "old"), (2, "kept")))])
    before = shown(pub)

    def stops():
        raise RuntimeError("lost")

    parts = [("log", rows(spark, (1, "x"), (2, "y"))), ("a", rows(spark, (1, "new"))), ("b", rows(spark, (5, "five"))), ("c", stops), *[(n, rows(spark, (9, n))) for n in "defghij"]]
    with pytest.raises(RuntimeError):
        pub.publish("two", parts)
    assert shown(pub) == before
    parts[3] = ("c", lambda: rows(spark, (7, "seven")))
    version = pub.publish("two", parts)
    after = shown(pub)
    assert after["log"] == [(1, "x"), (1, "x"), (2, "y")] and after["a"] == [(1, "new"), (2, "kept")] and after["c"] == [(7, "seven")] and all(after[n] == [(9, n)] for n in "defghij")
    assert pub.publish("two", parts) == version and shown(pub) == after  # run again
    pub.publish("three", [("a", rows(spark, (1, None)).withColumn("deleted", F.lit(True)))])
    assert shown(pub)["a"] == [(2, "kept")]
    pub.compact("a")
    assert shown(pub)["a"] == [(2, "kept")] and len(pub.manifest()["tables"]["a"]) == 1


def test_who_read_what_changed_is_refused_and_writers_lose_nothing(spark, tmp_path):
    pub = Publication(spark, str(tmp_path), PARTS)
    pub.publish("one", [("a", rows(spark, (1, "x")))])
    with pytest.raises(Conflict):
        pub.publish("late", [("a", rows(spark, (1, "y")))], read=0)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: pub.publish(f"t{i}", [("log", rows(spark, (i, "t")))]), range(8)))
    assert shown(pub)["log"] == [(i, "t") for i in range(8)] and pub.manifest()["version"] == 9
    path = f"{tmp_path}/once"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: put_once(spark, path, str(i)), range(40))) == 1


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    pub = Publication(spark, str(tmp_path), PARTS)
    pub.publish("one", [("a", rows(spark, *[(i, str(i)) for i in range(100)]))])
    some = pub.read("a", rows(spark, (3, ""), (200, "")).limit(1))
    assert [(r.k, r.v) for r in some.collect()] == [(3, "3")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and sum(len(list(p.iterdir())) for p in (tmp_path / "data/a").iterdir()) > 2
    assert pub.read("a", rows(spark, (1, "")).limit(0)).count() == 0


T0 = dt.datetime(2024, 1, 1)


def job(i, source, minutes=0, attempt=0, most=3):
    return (i, source, "pending", T0 + dt.timedelta(minutes=minutes), T0, T0, attempt, most, None, None, None)


def at(minutes):
    return F.lit(T0 + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")


def states(queue):
    return {r.job_id: r.state for r in queue.tables.read("jobs").collect()}


def test_two_workers_never_get_one_job(spark, tmp_path):
    queue = Queue(spark, str(tmp_path))
    queue.add(spark.createDataFrame([job(i, i % 3, random.Random(1).randrange(9)) for i in range(6)], JOB))

    def work(name):
        won = []
        while (i := queue.claim(name, at(60))) is not None:
            won.append(i)
        return won

    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(work, ["w1", "w2", "w3"]))
    assert sorted(sum(won, [])) == list(range(6)) and set(states(queue).values()) == {"running"}
    owners = {r.job_id: r.lease_owner for r in queue.tables.read("jobs").collect()}
    assert all(owners[i] == f"w{n}" for n, mine in enumerate(won, 1) for i in mine)


def test_circuits_trials_dead_letters_and_completion(spark, tmp_path):
    queue = Queue(spark, str(tmp_path))
    queue.add(spark.createDataFrame([job(1, 7, 0), job(2, 7, 1), job(3, 7, 2, attempt=3), job(4, 8, 3), job(5, 7, 4)], JOB))
    assert queue.claim("w", at(10)) == 1 and queue.fail(1, "w", at(10), "boom", threshold=1, reset_seconds=600)
    assert queue.claim("w", at(12)) == 4  # 7 is open: its jobs wait
    waiting = {r.job_id: r.available_at for r in queue.tables.read("jobs").collect()}
    assert waiting[2] == waiting[3] == T0 + dt.timedelta(minutes=20)
    assert queue.claim("w", at(21)) == 1 and queue.claim("w", at(21)) is None  # one trial
    trial = {r.source_id: (r.circuit, r.trial_job) for r in queue.tables.read("circuits").collect()}
    assert trial[7] == ("half_open", 1)
    seen = spark.createDataFrame([("o1", 7, "{}")], "observation_id string, source_id long, payload string")
    assert not queue.complete(1, "other", at(22), seen, "p1", at(22)) and queue.tables.read("observations").count() == 0
    assert queue.complete(1, "w", at(22), seen, "p1", at(22)) and not queue.complete(1, "w", at(22), seen, "p1", at(22))
    assert [(r.version, r.position) for r in queue.tables.read("checkpoints").collect()] == [(1, "p1")] and queue.tables.read("observations").count() == 1
    assert {r.source_id: r.circuit for r in queue.tables.read("circuits").collect()}[7] == "closed"
    assert queue.claim("w", at(23)) == 2 and queue.claim("w", at(23)) == 5
    assert states(queue) == {1: "completed", 2: "running", 3: "dead_letter", 4: "running", 5: "running"}
