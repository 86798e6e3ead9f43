"""Projections that follow a stream of statements with keyed state.

The state of an entity holds the latest revision of each of its records, so a batch reads the entities that it
touches and nothing else: neither the statements that came before nor the projection. What counts at a time is then
reconciled by the same functions as in batch. An entity that is left without a row gets a tombstone, and one of which a
statement ends by itself is reconciled again when its time has come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from evistrata.operators.revisions import RevisionSpec

#: Statements travel through the state as JSON; times keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Statements that a record names beside its latest revision; beyond them each has a key of its own.
SEEN = 64
_OUT = "entity string, kind string, payload string, carried string"
_FOLDS = {"count": lambda old, new: (old or 0) + 1, "min": lambda old, new: new if old is None else old if new is None else min(old, new), "max": lambda old, new: new if old is None else old if new is None else max(old, new)}


@dataclass(frozen=True)
class Family:
    """How one family of statements is followed.

    ``key`` names the entity, ``statement`` one immutable statement, ``spec`` its revisions, ``reconcile`` gives the
    entities of a DataFrame of statements. ``expires`` lists columns at whose time an entity must be looked at again.
    ``carried`` has columns that stand for the whole history and not for what counts now: a fold (count, min, max) and
    the column that it reads.
    """

    key: str
    reconcile: Callable[[DataFrame], DataFrame]
    spec: RevisionSpec = RevisionSpec()
    statement: str = "snapshot_id"
    expires: tuple[str, ...] = ()
    carried: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def _rank(told: str) -> list:
    """Comparable as Spark orders structs: nulls first."""
    return [[v is not None, 0 if v is None else v] for v in json.loads(told).values()]


class LatestStatements(StatefulProcessor):
    """For each entity the latest revision of every record with the statements seen of it, and folds over all of them.

    Rows come as ``entity, record, statement, rank, due`` (epoch milliseconds), ``folds, payload``; what is not a plain
    string is JSON. Out go the new statements, each once, and all latest ones of the entity. Older revisions whose column
    ``keep_replacing`` names another record stay too where replacing takes effect from every revision.

    Every call of the state is a message to the JVM: an entity that is new asks for its history only, and a record is read and
    written once in a batch.
    """

    def __init__(self, folds: list[str], keep_replacing: str | None, keep_ms: int | None, timed: bool) -> None:
        self.folds, self.keep_replacing, self.keep_ms, self.timed = folds, keep_replacing, keep_ms, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "record string", "rank string, due array<long>, payload string, seen array<string>, more boolean", self.keep_ms)
        self.seen = handle.getMapState("seen", "statement string", "n int", self.keep_ms)
        self.history = handle.getValueState("history", "folds string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.history.get()
        new = stored is None  # nothing is known of the entity, so the state need not be asked
        folds = [None] * len(self.folds) if new else json.loads(stored[0])
        held: dict[str, tuple | None] = {}  # what this batch has found of each record, so that the state is asked once
        seen: dict[str, set] = {}
        more, changed, replaced = set(), set(), {}
        for r in rows:
            if r.record not in held:
                known = None if new or not self.latest.containsKey((r.record,)) else self.latest.getValue((r.record,))
                held[r.record], seen[r.record] = known and tuple(known)[:3], set(known[3] if known else ())
                if known and known[4]:
                    more.add(r.record)
            if r.statement in seen[r.record] or r.record in more and self.seen.containsKey((r.statement,)):
                continue
            seen[r.record].add(r.statement)
            changed.add(r.record)
            yield Row(entity=key[0], kind="new", payload=r.payload, carried=None)
            folds = [_FOLDS[f](old, new_) for f, old, new_ in zip(self.folds, folds, json.loads(r.folds).values(), strict=True)]
            known, now = held[r.record], (r.rank, r.due, r.payload)
            if known is None or _rank(known[0]) <= _rank(r.rank):
                held[r.record], older = now, known
            else:
                older = now
            if self.keep_replacing and older is not None and json.loads(older[2]).get(self.keep_replacing) is not None:
                replaced[f"{r.record}\0{older[0]}"] = older
        for record, older in replaced.items():
            self.latest.updateValue((record,), (*older, [], False))
        for record in changed:
            if len(seen[record]) > SEEN:  # a record of very many revisions: its statements get keys of their own
                for statement in seen[record]:
                    self.seen.updateValue((statement,), (1,))
                seen[record] = ()
                more.add(record)
            self.latest.updateValue((record,), (*held[record], [*seen[record]], record in more))
        if new or changed:
            self.history.update((json.dumps(folds),))
        if self.timed:
            now_ms = timerValues.getCurrentProcessingTimeInMs()
            for due in {d for record in changed for d in held[record][1] or () if d is not None and d > now_ms}:
                self.handle.registerTimer(due)
        yield from self._told(key, folds, [v[2] for v in (*held.values(), *replaced.values())]) if new else self._all(key, folds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.history.exists():
            yield from self._all(key, json.loads(self.history.get()[0]))

    def _all(self, key, folds) -> Iterator[Row]:
        yield from self._told(key, folds, (value[2] for _, value in self.latest.iterator()))

    def _told(self, key, folds, payloads) -> Iterator[Row]:
        none, carried = True, json.dumps(folds)
        for payload in payloads:
            none = False
            yield Row(entity=key[0], kind="latest", payload=payload, carried=carried)
        if none:  # all that was known has outlived its time
            yield Row(entity=key[0], kind="latest", payload=None, carried=carried)

    def close(self) -> None:
        pass


def _number(stream: DataFrame, name: str) -> Column:
    """Times as microseconds, so that JSON keeps them exact and in order."""
    kind = stream.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    return F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, TimestampNTZType) else F.col(name)


def _encoded(stream: DataFrame, family: Family) -> DataFrame:
    spec = family.spec
    as_json = lambda cols: F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
    folded = [F.lit(None).cast("long") if f == "count" else _number(stream, c) for f, c in family.carried.values()]
    return stream.select(
        F.col(family.key).cast("string").alias("entity"), as_json([F.col(k) for k in spec.keys]).alias("record"),
        F.col(family.statement).cast("string").alias("statement"), as_json([_number(stream, c) for c in (*spec.order, *spec.ties)]).alias("rank"),
        F.array(*[F.unix_millis(F.col(c).cast("timestamp")) for c in family.expires]).cast("array<long>").alias("due") if family.expires else F.array().cast("array<long>").alias("due"),
        as_json(folded).alias("folds"),
        F.to_json(F.struct(*stream.columns), TIMES).alias("payload"),
    )


def follow(stream: DataFrame, family: Family, path: str, checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, keep_ms: int | None = None, **trigger) -> StreamingQuery:
    """Keep the projection of ``family`` below ``path`` in step with a stream of immutable statements.

    After every batch ``current(...)`` holds what ``family.reconcile`` gives for all statements so far, each entity taken by
    itself; a statement that comes again changes nothing. With a ``processingTime`` trigger entities are also reconciled again
    when a time in ``family.expires`` has come; a query that ends with its input has no such timers. ``reconcile`` may take a time as its second argument, which
    is ``clock()`` of the batch. ``keep_ms`` forgets records that were not renewed for so long. New statements are appended
    to ``path/history``. All writes of a batch overwrite those of an attempt before, so a batch can be run again.
    A null entity or record is one more value. The state is kept by RocksDB, partitioned by the entity.
    """
    spark, schema = stream.sparkSession, stream.schema
    timed = bool(family.expires) and "processingTime" in trigger  # a query that ends with its input has no time to wait for
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = LatestStatements([f for f, _ in family.carried.values()], family.spec.supersedes if family.spec.from_all else None, keep_ms, timed)
    states = _encoded(stream, family).groupBy("entity").transformWithState(processor, _OUT, "update", "processingTime" if timed else "none")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stage = f"{path}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(stage)  # the state is asked once
        told = session.read.schema(batch.schema).parquet(stage)
        statements = lambda kind: told.filter((F.col("kind") == kind) & F.col("payload").isNotNull()).select(F.from_json("payload", schema, TIMES).alias("r")).select("r.*")
        statements("new").write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        versions(told, family, family.reconcile(statements("latest"), clock())).write.mode("overwrite").parquet(f"{path}/projection/version={number}")

    return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def versions(told: DataFrame, family: Family, found: DataFrame) -> DataFrame:
    """Rows of the touched entities with ``deleted``: those found, and a tombstone for each of which nothing is left."""
    touched = told.filter("kind = 'latest'").groupBy("entity").agg(F.first("carried").alias("_carried"))
    mine = F.coalesce(F.col(family.key).cast("string"), F.lit("\0"))
    met = found.withColumns({"_entity": mine, "_there": F.lit(True)}).join(touched.withColumn("_entity", F.coalesce("entity", F.lit("\0"))).drop("entity"), "_entity", "full_outer")
    folds = F.from_json("_carried", "array<string>")
    columns = {}
    for i, name in enumerate(family.carried):
        kind, text = found.schema[name].dataType, F.get(folds, F.lit(i))
        columns[name] = F.timestamp_micros(text.cast("long")).cast(kind) if isinstance(kind, (TimestampType, TimestampNTZType)) else text.cast(kind)
    columns[family.key] = F.coalesce(F.col(family.key), F.nullif("_entity", F.lit("\0")).cast(found.schema[family.key].dataType))
    return met.withColumns(columns | {"deleted": F.col("_there").isNull()}).select(*found.columns, "deleted")


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each entity over all versions, without those whose newest is a tombstone."""
    rows = spark.read.option("basePath", f"{path}/projection").parquet(f"{path}/projection")
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "version")]), "version").alias("r")
    return rows.groupBy(key).agg(newest).select(key, "r.*").filter("not deleted").drop("deleted")


def compact(spark: SparkSession, path: str, to: str, key: str) -> None:
    """Write the current rows as one version below another folder, so that old versions can go."""
    current(spark, path, key).withColumns({"deleted": F.lit(False), "version": F.lit(0)}).write.partitionBy("version").parquet(f"{to}/projection")
