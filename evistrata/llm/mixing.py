"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every document of a source should be taken ``target / size`` times. The whole part is certain; the
fractional parts are rounded together: two documents exchange mass, each unit weighted by its size, in
a random direction until one of them is 0 or 1, and the other goes on to meet the next. The words that
a source gives are thus kept exactly at each exchange, and every document keeps its own expectation.
Documents meet in blocks of about ``FAN_IN``; what a block leaves undecided is one document, and the
leftovers of a source meet again in blocks, level by level, until one is left for each source. That last one is rounded to the nearer side, so a
source misses its target by at most half of one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm.shared import materialize, spare_names, text_size, uniform

#: Mean number of documents that meet in one block of the reduction tree.
FAN_IN = 128
WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code point order, null last, get ``weights`` in turn. Targets share the total of all
    sizes by weight, but stop at ``most`` times the source's size; what is cut off goes to the others by
    weight until none is above. One row per source is all that meets in one task here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)})
    # level: the target is least(cap, level * weight); sources reach their caps in the order of cap / weight
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    run = materialize(capped.withColumns({c: F.coalesce(F.sum(v).over(before), F.lit(0.0)) for c, v in (("caps", "cap"), ("weights", "weight"))}), "mix-source-run")
    whole = run.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    leveled = run.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))
    reach = F.col("cap") / F.col("weight")
    line = leveled.filter(F.col("level") <= reach).agg(F.min_by("level", F.struct(reach.alias("reach"), "rank")).alias("line"))  # one row each
    target = F.least(F.col("cap"), F.coalesce(F.col("line") * F.col("weight"), F.col("cap")))
    return leveled.crossJoin(F.broadcast(line)).select("source", "source_size", target.cast("double").alias("target"))


#: One exchange: ``s`` is what is undecided so far, ``x`` the next document. With weight w = size * rows,
#: x may rise by up to ``up`` and fall by up to ``down`` words while both chances stay within 0 and 1.
_EXCHANGE = """
aggregate(
  block,
  cast(null as struct<open:struct<id:bigint,w:double,p:double,u:double>,done:array<struct<id:bigint,take:int>>>),
  (s, x) -> case
    when s is null then named_struct('open', x, 'done', cast(array() as array<struct<id:bigint,take:int>>))
    else transform(array(named_struct(
        'up', least(s.open.p * s.open.w, (1 - x.p) * x.w),
        'down', least((1 - s.open.p) * s.open.w, x.p * x.w))), e ->
      transform(array(e.up + e.down <= 0 or x.u * (e.up + e.down) < e.down), rising ->
        transform(array(named_struct(
            'd', case when rising then e.up else -e.down end,
            's_ends', case when rising then s.open.p * s.open.w <= (1 - x.p) * x.w
                           else (1 - s.open.p) * s.open.w <= x.p * x.w end)), n ->
          case when n.s_ends then named_struct(
              'open', named_struct('id', x.id, 'w', x.w, 'p', least(1D, greatest(0D, x.p + n.d / x.w)), 'u', x.u),
              'done', concat(s.done, array(named_struct('id', s.open.id, 'take', case when rising then 0 else 1 end))))
          else named_struct(
              'open', named_struct('id', s.open.id, 'w', s.open.w, 'p', least(1D, greatest(0D, s.open.p - n.d / s.open.w)), 'u', s.open.u),
              'done', concat(s.done, array(named_struct('id', x.id, 'take', case when rising then 1 else 0 end))))
          end)[0])[0])[0]
    end)
"""


def _told_apart(units: DataFrame) -> DataFrame:
    """``units`` in which no two share an ``id``: where hashes meet, the later ones count up from it."""
    if not units.groupBy("id").count().filter("count > 1").limit(1).count():
        return units
    turn = F.row_number().over(Window.partitionBy("id").orderBy("doc_id", "source", "size")) - 1
    return _told_apart(materialize(units.withColumn("id", F.col("id") + turn), "mix-units-apart"))


def _level(open_units: DataFrame, level: int, seed: int, fan_in: int) -> DataFrame:
    """Let the undecided units of each (source, block) meet; ``folded`` has the decided ones and the one left."""
    turn = F.struct("id", "w", "p", uniform(F.lit(seed), F.lit(level), F.col("id")).alias("u"))
    grouped = open_units.groupBy("source", "block", "blocks").agg(F.array_sort(F.collect_list(turn)).alias("block_units"))
    return grouped.select("source", "blocks", F.expr(_EXCHANGE.replace("  block,", "  block_units,", 1)).alias("folded"))


def copies(rows: DataFrame, seed: int = 17, fan_in: int = FAN_IN, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Units with their number of copies, and the sources with their targets.

    ``rows`` has ``doc_id, source, size``. Equal rows form one unit and share its number of copies.
    The first result has ``doc_id, source, size, copies``; the second is ``source_targets``.
    """
    sources = materialize(source_targets(rows, weights, most), "mix-sources")
    unit = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    per_source = materialize(unit.groupBy("source").agg(F.count("*").alias("units")), "mix-counts")
    joined = unit.join(sources.join(per_source, sources["source"].eqNullSafe(per_source["source"])).select(sources["source"].alias("s"), "units", rate.alias("rate")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = materialize(
        joined.select(
            "doc_id", "source", "size", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
            (F.col("size") * F.col("rows")).cast("double").alias("w"), "units", F.xxhash64(F.lit(seed), "doc_id", "source", "size").alias("id"),
        ),
        "mix-units",
    )
    units = _told_apart(units)
    # a unit of no words or without a fractional part has nothing to exchange
    blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / fan_in)).cast("long")
    now = units.filter("p > 0 and w > 0").select("source", "id", "w", "p", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("blocks")))
    decided, level = [], 0
    while True:
        folded = materialize(_level(now, level, seed, fan_in), f"mix-level{level}")
        decided.append(folded.select(F.explode("folded.done").alias("d")).select("d.id", "d.take"))
        most_blocks = folded.agg(F.max("blocks")).first()[0]
        left = folded.select("source", "blocks", "folded.open.*")
        if not most_blocks or most_blocks <= 1:
            decided.append(left.select("id", (F.col("p") >= 0.5).cast("int").alias("take")))
            break
        level += 1
        now = left.select("source", "id", "w", "p", F.greatest(F.lit(1), F.ceil(F.col("blocks") / fan_in)).cast("long").alias("blocks"))
        now = now.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1 + level), "id"), F.col("blocks")))
    takes = decided[0]
    for more in decided[1:]:
        takes = takes.unionByName(more)
    takes = materialize(takes, "mix-takes")
    given = units.join(takes.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"), "left")
    return given.select("doc_id", "source", "size", (F.col("whole") + F.coalesce("take", F.lit(0))).alias("copies")), sources


def mix(docs: DataFrame, seed: int = 17, text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``docs`` needs ``doc_id, source`` and the text. Null text and text without words have size 0 and
    are taken 0 times; a null source is a source of its own, last in order. Repeated rows with equal
    id, source and size get the same number of copies. An empty table gives an empty result; other
    columns are ignored. Equal seeds give equal results.
    """
    rows = materialize(docs.select("doc_id", "source", text_size(text_col).alias("size")), "mix-rows")
    units, sources = copies(rows, seed)
    known = units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), "copies", "source_size", "target")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size"))
    copies_ = F.when(F.col("size") > 0, F.col("copies")).otherwise(0)
    return rows.join(known, same).select("doc_id", "source", "size", "source_size", "target", copies_.alias("copies"), (F.col("size") * copies_).cast("long").alias("taken"))


def draw_mix(docs: DataFrame, seed: int = 17, text_col: str = "text") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix`` says, columns as they came.

    There is a count for every document, so this side grows with the corpus: the join is a sort-merge
    join at every size.
    """
    units, _ = copies(materialize(docs.select("doc_id", "source", text_size(text_col).alias("size")), "mix-rows"), seed)
    i, s, n, c, k = spare_names(docs, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_copy")
    taken = materialize(units.filter("copies > 0 and size > 0"), "mix-taken").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(c))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (text_size(text_col) == F.col(n))
    return docs.join(taken.hint("merge"), same).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[F.col(f"`{x}`") for x in docs.columns])
