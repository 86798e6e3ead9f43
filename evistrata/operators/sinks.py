"""Idempotent writes as joins: insert what is new, merge, keep the newest, synchronise, redact."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_new(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not stored, one per key; a row with a null key conflicts with none, stored or new."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fresh = new.filter(whole).dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
    return fresh.select(*new.columns).unionByName(new.filter(~whole))


def merge_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: bool = True) -> DataFrame:
    """Upsert by key, with the ``action`` that each row took. A null in ``new`` does not overwrite."""
    rest = [c for c in stored.columns if c not in keys]
    s, n = stored.withColumn("_s", F.lit(True)).alias("s"), new.withColumn("_n", F.lit(True)).alias("n")
    met = s.join(n, [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"s.{c}") if keep_old_if_null else F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_n").isNull(), "keep").otherwise("update")
    return met.select(*[F.coalesce(f"n.{k}", f"s.{k}").alias(k) for k in keys], *[pick(c).alias(c) for c in rest], action.alias("action"))


def newest(stored: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per key the row with the latest ``at``; on a tie the new row. Late data never takes a value back."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def synchronise(stored: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a child set has to become: every key with insert, refresh or delete."""
    s, w = stored.select(*keys).withColumn("_s", F.lit(True)), wanted.select(*keys).withColumn("_w", F.lit(True))
    return s.join(w, list(keys), "full_outer").select(*keys, F.when(F.col("_s").isNull(), "insert").when(F.col("_w").isNull(), "delete").otherwise("refresh").alias("action"))


def redact(rows: DataFrame, erased: DataFrame, key: str, columns: Sequence[str], pepper: str) -> DataFrame:
    """Replace ``columns`` of erased keys by a peppered hash; ``erased`` says which. Survives any replay of the rows."""
    marked = rows.join(erased.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    gone = F.coalesce("_gone", F.lit(False))
    return marked.select(key, *[F.when(gone, F.sha2(F.concat(F.lit(pepper), F.col(c)), 256)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns if c != key], gone.alias("erased"))


def touched(new: DataFrame, key: str) -> DataFrame:
    """Keys that a batch touches: all that has to be reconciled again."""
    return new.select(key).distinct()


def refresh(history: DataFrame, new: DataFrame, key: str, reconcile) -> DataFrame:
    """Reconcile again only the entities that ``new`` touches, from their whole history."""
    everything = history.unionByName(new)
    return reconcile(everything.join(touched(new, key), key, "left_semi").select(*everything.columns))


def persist(history: DataFrame, projection: DataFrame, new: DataFrame, record: Sequence[str], key: str, reconcile: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """History with what is new, and the projection in which only the touched entities were reconciled again."""
    fresh = only_new(history, new, record)
    again = refresh(history, fresh, key, reconcile)
    kept = projection.join(touched(fresh, key), key, "left_anti")
    return history.unionByName(fresh), kept.select(*projection.columns).unionByName(again.select(*projection.columns))


def persist_people(history: DataFrame, new: DataFrame, deleted: DataFrame, record: Sequence[str], key: str, reconcile: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reconciled professional facts of the keys that ``new`` touches; what was deleted never comes back."""
    alive = new.join(deleted.select(key).distinct(), key, "left_anti").select(*new.columns)
    return refresh(history.join(deleted.select(key).distinct(), key, "left_anti").select(*history.columns), only_new(history, alive, record), key, reconcile)


def replace_children(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children after every parent in ``new`` got exactly its new ones."""
    return stored.join(touched(new, key), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def upsert_opportunities(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """One opportunity for each hypothesis: values are overwritten, the analyst's state stays, and a snooze that ended asks for review."""
    values = [c for c in stored.columns if c not in ("hypothesis_id", "state", "snoozed_until")]
    s, n = stored.withColumn("_s", F.lit(True)).alias("s"), new.withColumn("_n", F.lit(True)).alias("n")
    met = s.join(n, F.col("s.hypothesis_id") == F.col("n.hypothesis_id"), "full_outer")
    woken = F.col("_n") & (F.col("s.state") == "snoozed") & (F.col("s.snoozed_until") <= now)
    woken = F.coalesce(woken, F.lit(False))
    state = F.when(F.col("_s").isNull(), F.col("n.state")).when(woken, "needs_review").otherwise(F.col("s.state"))
    return met.select(
        F.coalesce("n.hypothesis_id", "s.hypothesis_id").alias("hypothesis_id"), state.alias("state"), F.when(~woken, F.col("s.snoozed_until")).alias("snoozed_until"),
        *[F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values],
    )


def sync_components(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """Score components by (opportunity, rule) after a new generation.

    Rules that were not generated go. An overridden component keeps the analyst's value and weight and
    remembers the generated ones as ``original_value`` and ``original_weight``.
    """
    keys = ["opportunity_id", "rule"]
    s = stored.select(*keys, F.col("value").alias("_value"), F.col("weight").alias("_weight"), "overridden")
    met = generated.join(s, keys, "left")
    own = F.coalesce("overridden", F.lit(False))
    pick = lambda c: F.when(own, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*keys, pick("value"), pick("weight"), own.alias("overridden"), F.when(own, F.col("value")).alias("original_value"), F.when(own, F.col("weight")).alias("original_weight"))


def wandering_records(rows: DataFrame, record: Sequence[str], entity: str, supersedes: str) -> DataFrame:
    """``record, violation``: records that tell of several entities, and records that supersede one of another entity."""
    several = rows.groupBy(*record).agg(F.count_distinct(entity).alias("n")).filter("n > 1").select(*record, F.lit("several entities").alias("violation"))
    source, key = record
    home = rows.select(F.col(source).alias("_s"), F.col(key).alias("_k"), F.col(entity).alias("_e")).distinct()
    met = rows.join(home, (F.col(source) == F.col("_s")) & (F.col(supersedes) == F.col("_k"))).filter(F.col(entity) != F.col("_e"))
    return several.unionByName(met.select(*record, F.lit("supersedes another entity").alias("violation")).distinct())


def roll_up_procedures(publications: DataFrame) -> DataFrame:
    """One row per procedure: first and newest publication, the newest title and state, all sources; a changed buyer is told."""
    at = F.coalesce("published_at", "collected_at")
    newest = F.max_by(F.struct("title", "status"), F.struct(at, "publication_id"))
    found = publications.groupBy("procedure_key").agg(
        newest.alias("n"), F.min("published_at").alias("first_published_at"), F.max(at).alias("latest_published_at"), F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.min("buyer_id").alias("buyer_id"), (F.count_distinct("buyer_id") > 1).alias("buyer_changed"), F.count("*").alias("publications"),
    )
    return found.select("procedure_key", "buyer_id", "n.title", "n.status", "first_published_at", "latest_published_at", "source_ids", "buyer_changed", "publications")


def merge_resources(seen: DataFrame) -> DataFrame:
    """Public resources from their sightings: earliest discovery, state of the newest sighting, the newest title that is none of null."""
    order = F.struct("last_seen_at", "sighting_id")
    return seen.groupBy("resource_key").agg(
        F.min("first_discovered_at").alias("first_discovered_at"), F.max("last_seen_at").alias("last_seen_at"), F.max_by("status", order).alias("status"),
        F.max_by(F.when(F.col("title").isNotNull(), F.col("title")), F.when(F.col("title").isNotNull(), order)).alias("title"), F.count_distinct("content_hash").alias("versions"),
    )


def merge_organizations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Organizations: a null never overwrites, identifiers are united in order, ``updated_at`` is the latest."""
    s, n = stored.alias("s"), new.alias("n")
    met = s.join(n, F.col("s.organization_id") == F.col("n.organization_id"), "full_outer")
    none = F.array().cast("array<string>")
    special = {"registration_ids": F.array_distinct(F.concat(F.coalesce("s.registration_ids", none), F.coalesce("n.registration_ids", none))), "updated_at": F.greatest("s.updated_at", "n.updated_at")}
    return met.select(*[special.get(c, F.coalesce(f"n.{c}", f"s.{c}")).alias(c) for c in stored.columns])


def only_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of known sources."""
    return new.join(known.select(key).distinct(), key, "left_semi")


def clashing(stored: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Keys that have other content in ``new`` than stored, or several contents in ``new``: they must not be written."""
    both = stored.select(*keys, content).unionByName(new.select(*keys, content))
    return both.join(new.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.count_distinct(content).alias("contents")).filter("contents > 1")


def insert_or_clash(stored: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> tuple[DataFrame, DataFrame]:
    """New rows to write, and the keys in conflict, whose rows are left out."""
    bad = clashing(stored, new, keys, content)
    return only_new(stored, new.join(bad, list(keys), "left_anti").select(*new.columns), keys), bad


def catalog_candidates(found: DataFrame, origin: str) -> DataFrame:
    """Candidate sources with an id from the origin and the lower-case address, one each."""
    key = F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat(F.lit(f"{origin}:"), F.lower("url")), 256), 1, 20))
    return found.withColumn("candidate_id", key).groupBy("candidate_id").agg(F.min_by(F.struct("name", "url"), "url").alias("r")).select("candidate_id", "r.name", "r.url")


def identity_conflicts(claims: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Winners and conflicts of identity claims.

    A field is in conflict if the claims of an identity give it more than one value, spaces and case aside.
    The claim of the best source (``priority``), then the most confident, then the newest wins.
    """
    each = claims.select("identity_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.col(f).cast("string"))).alias("v")) for f in fields]))).filter("v <> ''")
    torn = each.groupBy("identity_id", "field").agg(F.count_distinct("v").alias("n")).filter("n > 1")
    conflicts = torn.groupBy("identity_id").agg(F.array_sort(F.collect_set("field")).alias("conflicts"))
    winner = claims.groupBy("identity_id").agg(F.max_by(F.struct("claim_id", *fields), F.struct("priority", "confidence", "observed_at", "claim_id")).alias("w")).select("identity_id", "w.*")
    return winner.join(conflicts, "identity_id", "left"), conflicts


def erase_everywhere(tables: dict[str, tuple[DataFrame, Sequence[str]]], removed: DataFrame, person: str, erased: DataFrame, audit_value: Column, now: Column, least_days: int) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Redact the erased persons in every table, drop their rows of ``removed``, and tell it in an audit.

    ``tables`` gives each table with the columns to empty. The audit keeps a peppered hash of who was
    erased (``audit_value``), never the person, until the retention floor ends.
    """
    gone = erased.select(person).distinct().withColumn("_gone", F.lit(True))
    out = {}
    for name, (rows, columns) in tables.items():
        marked = rows.join(gone, person, "left")
        hide = F.coalesce("_gone", F.lit(False))
        out[name] = marked.select(*[F.when(~hide, F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], hide.alias("deleted"))
    left = removed.join(gone, person, "left_anti").select(*removed.columns)
    audit = erased.select(audit_value.alias("subject_hash"), now.alias("erased_at"), (now + F.make_dt_interval(F.lit(least_days))).alias("kept_until"))
    return out, left, audit


#: What is stored from a batch: of a historical one no signals, identities or changes.
SINKS = ("observations", "organizations", "evidence", "signals", "identities", "relationships", "incidents", "changes", "indicators", "vulnerabilities", "resources")
NOT_HISTORICAL = ("signals", "identities", "changes")


def fan_out(batch: dict[str, DataFrame], write: Callable[[str, DataFrame], None], historical: bool = False) -> list[str]:
    """Write the parts of a batch in the fixed order of the sinks; each write is idempotent, so a batch can be run again."""
    done = [name for name in SINKS if name in batch and not (historical and name in NOT_HISTORICAL)]
    for name in done:
        write(name, batch[name])
    return done
