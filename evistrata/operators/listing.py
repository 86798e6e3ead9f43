"""Pages and details of reconciled entities: filters, children that must exist, totals, one page, nested children."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200


@dataclass(frozen=True)
class Listing:
    """How a family is listed: ``order`` are columns (``-`` before a falling one, nulls last), ``searched`` are searched for a text."""

    order: Sequence[str]
    searched: Sequence[str] = ()


INCIDENTS = Listing(("-last_updated_at", "incident_key"), ("title", "summary", "names"))
CHANGES = Listing(("-last_updated_at", "event_key"), ("title", "event_type"))
RELATIONSHIPS = Listing(("-confidence", "relationship_key"), ("role",))
INDICATORS = Listing(("-last_seen_at", "indicator_key"), ("indicator_key",))
ASSETS = Listing(("-last_updated_at", "asset_key"), ("asset_key",))
VULNERABILITIES = Listing(("-modified_at", "canonical_id"), ("canonical_id", "title", "description"))
APPLICABILITY = Listing(("-confidence", "technology_id", "vulnerability_id"), ("vendor", "product", "version", "state", "title"))
OPPORTUNITIES = Listing(("-score", "-last_evidence_at", "organization_id"))
HYPOTHESES = Listing(("-confidence", "-expires_at", "organization_id", "requested_class", "family"))
NODES = Listing(("-confidence", "node_key"), ("display_name", "node_key"))
RESOLUTIONS = Listing(("-requires_review", "-score", "created_at", "node_key", "organization_id"))
PEOPLE = Listing(("display_name", "person_key"), ("display_name",))
MERGES = Listing(("state", "-score", "-created_at", "identity_id", "organization_id"))
APPROVALS = Listing(("-updated_at", "source_id"))
PLANS = Listing(("-updated_at", "plan_id"))


def sought(columns: Sequence[str], text: str) -> Column:
    """Whether one of the columns contains the text, in any case; ``%`` and ``_`` stay wild cards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False))
    return found


def selected(rows: DataFrame, spec: Listing, where: Column | None = None, text: str | None = None, exists: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Rows of a family: a condition, a searched text, and children (rows, key) that must exist, each on its own."""
    out = rows if where is None else rows.filter(where)
    if text:
        out = out.filter(sought(spec.searched, text))
    for child, key in exists:
        out = out.join(child.select(key).distinct(), key, "left_semi")
    return out


def page(rows: DataFrame, spec: Listing, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in the order of the family: a top-k, never a full sort."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}, offset 0 or more")
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in spec.order]
    return rows.orderBy(*order).offset(offset).limit(limit)


def children(rows: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], name: str, falling: bool = False) -> DataFrame:
    """``key, name``: the children of each entity as an array of structs in order, with their number ``n_name``."""
    listed = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*columns).alias("row"))), not falling)
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["row"]).alias(name), F.count("*").alias(f"n_{name}"))


def detail(entities: DataFrame, key: str, value, parts: dict[str, tuple[DataFrame, Sequence[str], Sequence[str], bool]]) -> DataFrame:
    """One entity with its children; only the children of that entity are gathered.

    ``parts`` gives for each name the rows, their shown columns, their order and whether it falls.
    """
    out = entities.filter(F.col(key) == value)
    for name, (rows, columns, order, falling) in parts.items():
        found = children(rows.filter(F.col(key) == value), key, columns, order, name, falling)
        out = out.join(found, key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def with_counts(entities: DataFrame, key: str, parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """All entities with an aggregate of each kind of child, grouped once before each join instead of asked for row by row."""
    out = entities
    for name, (rows, value) in parts.items():
        out = out.join(rows.groupBy(key).agg(value.alias(name)), key, "left")
    return out
