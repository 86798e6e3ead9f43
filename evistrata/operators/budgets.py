"""Budgets that are used up in order: a fold over the sorted rows of each scope, with the usage kept between batches.

A refused row takes nothing, so what a row may use depends on the decisions before it and no running sum gives it. Rows are
dealt by scope and sorted; a task goes over them in Arrow batches and holds the usage of one scope. A call takes the usage so
far and gives it back, so a scope is gone through in as many calls as its rows come in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evistrata.operators.governance import MAX_DEPTH, MAX_PAGES, MAX_REDIRECTS, MAX_RESOURCE_BYTES, MAX_TOTAL_BYTES, MIME_TYPES
from evistrata.operators.lineage import written

_LIMITS = {"max_depth": MAX_DEPTH, "max_redirects": MAX_REDIRECTS, "max_pages": MAX_PAGES, "max_total_bytes": MAX_TOTAL_BYTES, "max_resource_bytes": MAX_RESOURCE_BYTES}


def path_fits(path: Column, prefixes: Column) -> Column:
    """Whether a path is a prefix or lies below it."""
    return F.exists(prefixes, lambda p: (p == "/") | (path == p) | F.startswith(path, F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))))


def _limited(scopes: DataFrame, *names: str) -> DataFrame:
    """Scopes with a column for each limit; what is absent or null is the default."""
    return scopes.withColumns({n: (F.coalesce(F.col(n), F.lit(_LIMITS[n])) if n in scopes.columns else F.lit(_LIMITS[n])).cast("long") for n in names})


def _scope_rule(depth: Column | None = None, redirects: Column | None = None) -> Column:
    """The first rule that a target breaks whatever was used before; null if none."""
    depth, redirects = (F.lit(0) if c is None else c for c in (depth, redirects))
    return (
        F.when(~F.coalesce(F.array_contains("hosts", F.col("host")), F.lit(False)), "host_not_allowed").when(~F.coalesce(path_fits(F.col("path"), F.col("paths")), F.lit(False)), "path_not_allowed")
        .when((depth < 0) | (depth > F.col("max_depth")), "depth_exceeded").when((redirects < 0) | (redirects > F.col("max_redirects")), "redirect_limit_exceeded")
    )


class CrawlFold:
    """Goes over the targets of one scope after another: ``pages`` and ``bytes`` are what was fetched of the scope so far."""

    def __init__(self) -> None:
        self.scope, self.pages, self.bytes = None, 0, 0

    def step(self, scope, pages: int, used: int, max_pages: int, max_total: int, max_resource: int, size: int, mime_ok: bool) -> tuple[str, str | None]:
        if scope != self.scope:
            self.scope, self.pages, self.bytes = scope, pages, used
        if self.pages >= max_pages:
            return "page_budget_exceeded", None
        if self.bytes >= max_total:
            return "total_byte_budget_exceeded", None
        if not 0 <= size <= max_resource:
            return "allowed", "resource_size_exceeded"
        if self.bytes + size > max_total:
            return "allowed", "total_byte_budget_exceeded"
        if not mime_ok:
            return "allowed", "mime_not_allowed"
        self.pages += 1
        self.bytes += size
        return "allowed", "allowed"


def crawl(targets: DataFrame, scopes: DataFrame, usage: DataFrame | None = None, order: tuple[str, ...] = ("target_id",)) -> tuple[DataFrame, DataFrame]:
    """Decisions about ``targets`` and the usage of their scopes afterwards.

    ``targets`` has ``target_id, scope_id, host, path, depth, redirects, size, mime`` and is taken in ``order`` within a scope;
    ``scopes`` has ``scope_id, hosts, paths`` and limits (defaults where absent or null); ``usage`` has ``scope_id, pages, bytes``.
    First a target is judged (``target_reason``: host, path, depth, redirects, pages, bytes), then what came back for it
    (``response_reason``: size, bytes, media type; null where nothing was fetched). Only what passes both counts as a page
    and its bytes. Targets of unknown scopes give no row; a null size counts as 0, a null media type as one not allowed.
    """
    limited = _limited(scopes, *_LIMITS)
    rows = targets.join(limited, "scope_id")
    before = usage if usage is not None else scopes.select("scope_id", F.lit(0).alias("pages"), F.lit(0).alias("bytes"))
    rows = rows.join(before.select("scope_id", F.col("pages").cast("long").alias("_pages"), F.col("bytes").cast("long").alias("_bytes")), "scope_id", "left").fillna(0, ["_pages", "_bytes"])
    mime_ok = F.coalesce(F.lower(F.trim(F.split_part("mime", F.lit(";"), F.lit(1)))).isin(*MIME_TYPES), F.lit(False))
    judged = rows.select("target_id", "scope_id", _scope_rule(F.col("depth"), F.col("redirects")).alias("rule"), "_pages", "_bytes", "max_pages", "max_total_bytes", "max_resource_bytes", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), mime_ok.alias("mime_ok"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    refused = judged.filter("rule is not null").select("target_id", "scope_id", F.col("rule").alias("target_reason"), F.lit(None).cast("string").alias("response_reason"), F.lit(0).cast("long").alias("taken_pages"), F.lit(0).cast("long").alias("taken_bytes"))
    keys, names = [f"_o{i}" for i in range(len(order))], refused.columns
    turn = judged.filter("rule is null").repartition("scope_id").sortWithinPartitions("scope_id", *keys, "target_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = CrawlFold()
        for b in batches:
            told, pages, taken = [], [], []
            for row in zip(*[b.column(i).to_pylist() for i in range(1, 9)], strict=True):
                had = (fold.pages, fold.bytes) if row[0] == fold.scope else (row[1], row[2])
                told.append(fold.step(*row))
                pages.append(fold.pages - had[0])
                taken.append(fold.bytes - had[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in told], pa.string()), pa.array([r for _, r in told], pa.string()), pa.array(pages, pa.int64()), pa.array(taken, pa.int64())], names=names)

    schema = StructType([judged.schema["target_id"], judged.schema["scope_id"], StructField("target_reason", StringType()), StructField("response_reason", StringType()), StructField("taken_pages", LongType()), StructField("taken_bytes", LongType())])
    folded = turn.select("target_id", "scope_id", "_pages", "_bytes", "max_pages", "max_total_bytes", "max_resource_bytes", "size", "mime_ok").mapInArrow(run, schema)
    decided = written(folded.unionByName(refused), "crawl")
    spent = decided.groupBy("scope_id").agg(F.sum("taken_pages").alias("_p"), F.sum("taken_bytes").alias("_b"))
    total = lambda c, more: (F.coalesce(F.col(c).cast("long"), F.lit(0)) + F.coalesce(more, F.lit(0))).alias(c)
    after = before.select("scope_id", "pages", "bytes").join(spent, "scope_id", "full_outer").select("scope_id", total("pages", F.col("_p")), total("bytes", F.col("_b")))
    return decided.select("target_id", "scope_id", "target_reason", "response_reason"), after


class RouteFold:
    """Gives the hits of one organization and origin after another to their targets, which are told first.

    Targets are found by host and by path: any, the path itself, or one it lies below. What is used up never opens again, so it is
    dropped from the lists where it is met, and of the open ones two are enough to know that there are several.
    """

    def __init__(self) -> None:
        self.group, self.lists = None, {}

    def at(self, group) -> None:
        if group != self.group:
            self.group, self.lists = group, {}

    def target(self, target, hosts, paths, pages: int, most: int) -> None:
        entry = [target, pages, most]
        for host in {h for h in hosts or () if h is not None}:
            for place in {x for p in paths or () if p is not None for x in ((("any",) if p == "/" else ("at", p)), ("below", p.rstrip("/")))}:
                self.lists.setdefault((host, place), []).append(entry)

    def hit(self, host, path) -> tuple:
        places = [("any",)] if path is None else [("any",), ("at", path), *(("below", path[:i]) for i, c in enumerate(path) if c == "/")]
        found: list = []
        for place in places if host is not None else ():
            told = self.lists.get((host, place), [])
            i = 0
            while i < len(told) and len(found) < 2:
                if told[i][1] >= told[i][2]:
                    told[i] = told[-1]
                    told.pop()
                    continue
                if not any(told[i] is x for x in found):
                    found.append(told[i])
                i += 1
        if len(found) != 1:
            return None, "ambiguous_target" if found else "source_review"
        found[0][1] += 1
        return found[0][0], "public_web"


def route(candidates: DataFrame, targets: DataFrame, order: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """``candidate_id, target_id, route``: to the one target of its organization and origin that takes a search hit.

    ``candidates`` has ``candidate_id, organization_id, origin, host, path`` and is taken in ``order``; ``targets`` has ``target_id,
    organization_id, origin, hosts, paths``, whether it is ``executable``, limits, and the ``pages`` and ``bytes`` used so far (absent:
    yes, the defaults, none). A target whose scope refuses the hit, at the usage that hits before it left, is no match. Without a match the
    source needs a review; several at once are an error, told as ``ambiguous_target``; a match uses one page of its target.
    Hits and targets of a group meet in its fold and are never joined; a task holds the targets of one group.
    """
    told = _limited(targets, "max_pages", "max_total_bytes", "max_depth", "max_redirects")
    have = lambda c, default: F.coalesce(F.col(c), default) if c in targets.columns else default
    group = ["organization_id", "origin"]
    told = told.withColumns({"executable": have("executable", F.lit(True)), "pages": have("pages", F.lit(0)).cast("long"), "bytes": have("bytes", F.lit(0)).cast("long")})
    told = told.filter("executable and bytes < max_total_bytes and max_depth >= 0 and max_redirects >= 0 and organization_id is not null and origin is not null").select("target_id", *group, "hosts", "paths", "pages", "max_pages")
    rows = candidates.select("candidate_id", *group, "host", "path", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    groups = told.select(*group).distinct()
    alone = rows.join(groups, group, "left_anti").select("candidate_id", F.lit(None).cast(told.schema["target_id"].dataType).alias("target_id"), F.lit("source_review").alias("route"))
    hits = rows.join(groups, group, "left_semi").withColumn("_hit", F.lit(True))
    keys = [f"_o{i}" for i in range(len(order))]
    turn = hits.unionByName(told.withColumn("_hit", F.lit(False)), allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_hit", *keys, "candidate_id", "target_id")
    schema = StructType([rows.schema["candidate_id"], alone.schema["target_id"], StructField("route", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = RouteFold()
        for b in batches:
            ids, given, routes = [], [], []
            turns = zip(*[c.to_pylist() for c in b.columns[:6]], strict=True)
            fresh = zip(*[c.to_pylist() for c in b.filter(pc.invert(b.column(0))).columns[6:]], strict=True)
            for hit, organization, origin, candidate, host, path in turns:
                fold.at((organization, origin))
                if hit:
                    to, way = fold.hit(host, path)
                    ids.append(candidate)
                    given.append(to)
                    routes.append(way)
                else:
                    fold.target(*next(fresh))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(3).type), pa.array(given, b.schema.field(6).type), pa.array(routes, pa.string())], names=["candidate_id", "target_id", "route"])

    return turn.select("_hit", *group, "candidate_id", "host", "path", "target_id", "hosts", "paths", "pages", "max_pages").mapInArrow(run, schema).unionByName(alone)


def in_order(decide: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], parts: list[DataFrame], usage: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Decisions about the parts of a long list, one after the other, the usage written between them."""
    out = []
    for part in parts:
        decided, usage = decide(part, usage)
        usage = written(usage, "usage")
        out.append(decided)
    return out, usage
