"""Product, source and collection metrics, and the sequential quality state of a source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Volume band, field-drop rule, smoothing, samples before a baseline is trusted.
LOW, HIGH, ALPHA, WARM_UP = 0.2, 5.0, 0.25, 3
EXPECTED, DROP = 0.8, 0.4


def share(condition: str | Column) -> Column:
    """Share of rows, 0 for none."""
    c = F.col(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def precision_at(outcomes: DataFrame, k: int) -> DataFrame:
    """Accepted share of the k best scored; ties go to the smaller id. A top-k, never a full sort."""
    top = outcomes.orderBy(F.col("score").desc(), "outcome_id").limit(k)
    return top.agg(share("accepted").alias("precision_at_k"), F.count("*").alias("n"))


def outcome_metrics(outcomes: DataFrame) -> DataFrame:
    """Acceptance and false positive rates, mean latency, cost per accepted (null if none is), in one pass."""
    cost = F.sum(F.col("cost").cast("decimal(20,2)")).cast("double") / F.nullif(F.count_if("accepted"), F.lit(0))
    return outcomes.agg(share("accepted").alias("acceptance_rate"), share("false_positive").alias("false_positive_rate"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("mean_latency"), cost.alias("cost_per_accepted"))


def ablation(values: DataFrame, key: str, amount: str) -> DataFrame:
    """Totals with and without each source: one aggregation, then the total minus the source's part."""
    per = values.groupBy(key).agg(F.count("*").alias("events"), F.sum(amount).alias("amount"))
    everything = Window.partitionBy(F.lit(0))
    return per.select(key, "events", "amount", (F.sum("events").over(everything) - F.col("events")).alias("events_without"), (F.sum("amount").over(everything) - F.col("amount")).alias("amount_without"))


def collection_metrics(jobs: DataFrame, key: str, as_of: Column, lookback_days: int = 1) -> DataFrame:
    """Per source: counts by outcome, recent errors, volume, lag to the newest run."""
    kind = F.col("event_type")
    recent = F.col("run_at") > as_of - F.make_dt_interval(F.lit(lookback_days))
    return jobs.groupBy(key).agg(
        F.count("*").alias("runs"), *[F.count_if(kind == k).alias(f"n_{k}") for k in ("purchase", "view", "click", "error", "signup")], F.count_if((kind == "error") & recent).alias("recent_errors"),
        F.min(F.when(kind == "error", F.col("run_at"))).alias("oldest_error"), F.sum("records").alias("volume"), F.max("run_at").alias("last_run"),
    ).withColumn("lag_seconds", F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))) / 1_000_000))


def value_scores(events: DataFrame, key: str) -> DataFrame:
    """Weighted value per source (5 commercial, 3 identity, 1 each for the rest) relative to the best source."""
    w = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 3).otherwise(1)
    per = events.groupBy(key).agg(F.sum(w).alias("total"))
    return per.withColumn("score", F.col("total") / F.max("total").over(Window.partitionBy(F.lit(0))))


def field_population(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of rows with a non-blank value, per source and field."""
    return rows.groupBy(key).agg(*[share(F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False))).alias(f) for f in fields])


def quality_states(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Fold every source's runs in order; per source the samples, the anomalies and the final baseline.

    A run is judged against the smoothed baseline: record counts outside [0.2, 5] times it, a field that
    was mostly filled and drops, or a schema fingerprint that was not seen while warming up. Only runs
    without a finding, or the first three, move the baseline. A source's runs come sorted to one task,
    which folds them batch by batch and holds nothing but the state.
    """
    columns = [f"`{key}` {runs.schema[key].dataType.simpleString()}", "runs int", "samples int", "level double", "volume_anomalies int", "field_anomalies int", "schema_drifts int", "rejected int"]
    facts = [F.col("records").cast("double").alias("records"), F.col("population").cast("double").alias("population"), F.col("fingerprint").cast("string").alias("fingerprint")]
    ordered = runs.repartition(key).sortWithinPartitions(key, *order, "records", "population", "fingerprint").select(F.col(key), *facts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kind = None, None, None
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for k, *run in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or k != at and (k == k or at == at):
                    if state is not None:
                        done.append((at, state))
                    at, state = k, _Baseline()
                state.take(*run)
            if done:
                yield _told(key, done, kind)
        if state is not None:
            yield _told(key, [(at, state)], kind)

    return ordered.mapInArrow(fold, ", ".join(columns))


def _told(key: str, done: list[tuple[object, _Baseline]], kind: pa.DataType) -> pa.RecordBatch:
    counts = ("runs", "n", "level", "volume", "fields", "schema", "rejected")
    arrays = [pa.array([getattr(s, c) for _, s in done], pa.float64() if c == "level" else pa.int32()) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), *arrays], names=[key, "runs", "samples", "level", "volume_anomalies", "field_anomalies", "schema_drifts", "rejected"])


def _less(a: float | None, b: float | None) -> bool | None:
    """``a < b`` as in SQL: null for a null, and NaN is the largest number."""
    return None if a is None or b is None else a < b or b != b and a == a


def _any(*facts: bool | None) -> bool | None:
    """OR of SQL: true for a true one, else null for a null."""
    return True if True in facts else None if None in facts else False


class _Baseline:
    """The state of one source: counters, two smoothed values, fingerprints of at most ``WARM_UP`` runs."""

    def __init__(self) -> None:
        self.runs = self.n = self.volume = self.fields = self.schema = self.rejected = 0
        self.level: float | None = None
        self.field: float | None = None
        self.known: list[str | None] = []

    def take(self, records: float | None, population: float | None, fingerprint: str | None) -> None:
        self.runs += 1
        if self.n < WARM_UP:
            if fingerprint not in self.known:
                self.known.append(fingerprint)
            self._move(records, population)
            return
        scaled = lambda x: None if self.level is None else self.level * x
        volume = _less(0.0, records) if self.level == 0 else _any(_less(records, scaled(LOW)), _less(scaled(HIGH), records))
        filled, dropped = _less(self.field, EXPECTED), _less(population, None if self.field is None else self.field - DROP)
        field = False if filled is True or dropped is False else None if filled is None or dropped is None else True
        known = None if fingerprint is None else True if fingerprint in self.known else None if None in self.known else False
        finding = _any(volume, field, None if known is None else not known)
        self.volume += volume is True
        self.fields += field is True
        self.schema += known is False
        self.rejected += finding is True
        if finding is False:
            self._move(records, population)

    def _move(self, records: float | None, population: float | None) -> None:
        smooth = lambda old, new: new if old is None else None if new is None else (1 - ALPHA) * old + ALPHA * new
        self.n += 1
        self.level, self.field = smooth(self.level, records), smooth(self.field, population)


def circuit_states(outcomes: DataFrame, key: str, order: list[str], threshold: int) -> DataFrame:
    """How often a source failed ``threshold`` times in a row: runs of equal outcomes by gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    same = Window.partitionBy(key, "failed").orderBy(*order)
    islands = outcomes.withColumn("island", F.row_number().over(w) - F.row_number().over(same))
    runs = islands.filter("failed").groupBy(key, "island").agg(F.count("*").alias("length"))
    return runs.groupBy(key).agg(F.max("length").alias("longest"), F.sum(F.floor(F.col("length") / threshold)).cast("long").alias("opened"))
