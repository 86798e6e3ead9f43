"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring. A row belongs to the first point clockwise from its own
position; rows that a full shard can't take go on clockwise to the next point. Loads are bounded
tightly: with n rows, the first ``n mod shards`` shards take one row more than the others, so counts are
at most one apart, and most rows stay where the ring alone would put them.

What overflows depends on counts alone: the rows of an arc are ranked by position (in cells, and by hash
within a cell, so that no key needs one task), the driver plans with one count for each arc (a fixed number),
and the plan says which ranks of an arc go to which shard. Nothing depends on how the rows are stored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm.shared import materialize

SHARDS = 24
#: Points of a shard on the ring; cells of an arc, and parts of a cell, in which rows are ranked apart.
POINTS, CELLS, PARTS = 64, 16, 8
#: Equal rows are written out in runs of at most this many.
RUN = 4096
SEED = 3


def ring(shards: int, points: int = POINTS, seed: int = SEED) -> list[tuple[int, int]]:
    """(position, shard) of all points in clockwise order; positions are below 2 ** 62."""
    found = []
    for s in range(shards):
        rng = np.random.default_rng([seed, s])  # a shard's points don't depend on how many shards there are
        found += [(int(p), s) for p in rng.integers(0, 1 << 62, points)]
    return sorted(found)


def plan(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes what: (arc, first rank, one past the last rank, shard, first slot).

    In each turn every arc offers the rows that it still has to the point ``turn`` places clockwise, in
    order of the arcs; a shard takes them in order of rank as far as it has room. Ends when all are
    placed, which takes at most as many turns as there are points.
    """
    room, used, out = list(capacity), [0] * len(capacity), []
    waiting = [(a, 0, c) for a, c in enumerate(counts) if c]
    for turn in range(len(owners)):
        later = []
        for a, lo, hi in waiting:
            s = owners[(a + turn) % len(owners)]
            n = min(room[s], hi - lo)
            if n:
                out.append((a, lo, lo + n, s, used[s]))
                room[s] -= n
                used[s] += n
            if lo + n < hi:
                later.append((a, lo + n, hi))
        waiting = later
        if not waiting:
            return out
    raise ValueError("the shards have less room than there are rows")


def capacities(rows: int, shards: int) -> list[int]:
    """Room of each shard: as even as can be."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, seed: int = SEED, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key_col, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 8; a null text has no bytes. ``slot`` numbers the rows
    of a shard from 0 without gaps. A null key has a position like any other. Rows with equal keys start
    at the same position and are told apart by their other values; equal rows are interchangeable. An
    empty table gives an empty result; extra columns are ignored.
    """
    points_ = ring(shards, points, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    position = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key_col)), 2)
    rows = docs.select(F.col(key_col).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), position.alias("position"))
    # the arc is that of the first point at or after the position
    bounds = docs.sparkSession.createDataFrame([(i, (points_[i - 1][0] if i else -1), p) for i, (p, _) in enumerate(points_)] + [(0, points_[-1][0], 1 << 62)], "arc int, after long, upto long")
    # coarse cells of the ring turn the search into an equi-join with a table of fixed size
    cells = 1 << 12
    spans = bounds.select("arc", "after", "upto", F.explode(F.sequence(F.shiftright(F.greatest(F.col("after"), F.lit(0)), 50), F.shiftright(F.least("upto", F.lit((1 << 62) - 1)), 50))).alias("cell")).filter(F.col("cell") < cells)
    placed = rows.withColumn("cell", F.shiftright("position", 50)).join(F.broadcast(spans), "cell").filter("position > after and position <= upto")
    # cells follow the position; parts spread the rows of a cell, also those of one key; equal rows are one unit
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("position") - F.col("after")) / ((F.col("upto") - F.col("after") + 1) / CELLS))).cast("int")
    piece = cell * PARTS + F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int")
    units = placed.groupBy("key", "size", "text_crc32", "position", "arc", piece.alias("piece")).agg(F.count("*").alias("n"))
    units = materialize(units, "shard-units")
    counts = materialize(units.groupBy("arc", "piece").agg(F.sum("n").alias("n")), "shard-counts")  # at most points * shards * CELLS * PARTS rows
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", offset).drop("n")
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards * points rows
    by_arc = [per_arc.get(a, 0) for a in range(len(points_))]
    moves = plan(by_arc, [s for _, s in points_], capacities(sum(by_arc), shards))
    moves = docs.sparkSession.createDataFrame(moves, "arc int, lo long, hi long, shard int, slot0 long")
    order = Window.partitionBy("arc", "piece").orderBy("position", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.join(F.broadcast(offsets), ["arc", "piece"]).withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    met = ranked.join(F.broadcast(moves), "arc").filter("rank < hi and rank + n > lo")
    first = F.greatest("rank", "lo")
    runs = met.select("key", "size", "text_crc32", "shard", (F.col("slot0") + first - F.col("lo")).alias("slot0"), (F.least(F.col("rank") + F.col("n"), F.col("hi")) - first).alias("n"))
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))))
    last = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN).cast("int")
    rows = runs.withColumn("at", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.select(F.col("key").alias(key_col), "size", "text_crc32", "shard", (F.col("slot0") + F.col("run") * RUN + F.col("at")).cast("long").alias("slot"))
