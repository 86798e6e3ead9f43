"""Revision resolution: which of the immutable statements about a record counts now."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.lineage import cut

RECORD = ("source_id", "source_record_key")


@dataclass(frozen=True)
class RevisionSpec:
    """How the revisions of one family are resolved.

    ``keys`` name a record; of its revisions the largest by ``order`` (then ``ties``) counts.
    ``supersedes`` is the column that names another record of the same source which a statement
    replaces. It takes effect from the latest revisions only, or with ``from_all`` from every revision.
    With ``ignore_self`` a record can't replace itself. With ``fallback`` a group of which nothing is
    left keeps its newest statement.
    """

    keys: Sequence[str] = RECORD
    order: Sequence[str] = ("modified_at",)
    ties: Sequence[str] = ("snapshot_id",)
    supersedes: str | None = None
    from_all: bool = False
    ignore_self: bool = False
    fallback: str | None = None


def latest_by(rows: DataFrame, spec: RevisionSpec) -> DataFrame:
    """One row per record: ``max_by`` keeps it a partial aggregate, so hot records shrink before the shuffle."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(*spec.order, *spec.ties)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in spec.keys]).agg(newest).select("_row.*")


def effective(rows: DataFrame, spec: RevisionSpec) -> DataFrame:
    """The latest revisions that no statement of the same source supersedes."""
    latest = latest_by(rows, spec)
    if spec.supersedes is None:
        return latest
    source, record = spec.keys
    stated = (rows if spec.from_all else latest).filter(F.col(spec.supersedes).isNotNull())
    if spec.ignore_self:
        stated = stated.filter(F.col(spec.supersedes) != F.col(record))
    gone = stated.select(F.col(source), F.col(spec.supersedes).alias(record)).distinct()
    left = latest.join(gone, [source, record], "left_anti")
    if spec.fallback is None:
        return left.select(*rows.columns)
    bare = rows.join(left.select(spec.fallback).distinct(), spec.fallback, "left_anti")
    newest = F.max_by(F.struct(*rows.columns), F.struct(*spec.order, *spec.ties)).alias("_row")
    return left.select(*rows.columns).unionByName(bare.groupBy(F.col(spec.fallback).alias("_g")).agg(newest).select("_row.*"))


def reduce_state(events: DataFrame, key: str, order: Sequence[str], action: str, gone: Sequence[str] = ("tombstone", "retraction")) -> DataFrame:
    """The last event of each key, unless it takes the record away; events without a key don't count."""
    last = F.max_by(F.struct(*events.columns), F.struct(*order)).alias("_row")
    return events.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(last).select("_row.*").filter(~F.col(action).isin(*gone))


def supersession_cycles(rows: DataFrame, record: str, supersedes: str, max_rounds: int = 40) -> DataFrame:
    """Records that reach themselves by following ``supersedes``; column ``record``.

    Pointer doubling: after k rounds each record knows whom it reaches in 2**k steps, so chains of any
    length take a logarithmic number of joins. Records with one pointer each are expected; of several the
    smallest is followed.
    """
    step = rows.filter(F.col(supersedes).isNotNull()).groupBy(F.col(record).alias("a")).agg(F.min(supersedes).alias("b"))
    step = cut(step)
    reach, size = step, step.count()
    rounds = max(1, min(max_rounds, size.bit_length() + 1))
    for _ in range(rounds):  # after this many doublings only chains that end in a cycle still have a pointer
        reach = cut(reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")))
    on_cycle = reach.select(F.col("b").alias("a")).distinct()
    return on_cycle.withColumnRenamed("a", "record")


def previous_revision(rows: DataFrame, identity: str, order: Sequence[str], record: str, name: str = "previous_record_key") -> DataFrame:
    """Each row with the record key of the row before it in the same identity."""
    return rows.withColumn(name, F.lag(record).over(Window.partitionBy(identity).orderBy(*order)))
