"""Exact top-k search of 64-bit codes by Hamming distance with incremental multi-index hashing.

Codes are cut into segments of about log2(number of codes / 8) bits, so a value of a segment leads to about
eight codes at every size of the table: a probe, which is shuffled, costs more than a code that is checked. An inverted index from (segment, value) to codes is written once,
bucketed and sorted by that key. Two codes at distance d agree in some of m segments up to d // m bits.
Queries probe all values within a radius of their segments; the radii grow until the distance of the
k-th verified code is provably covered: with radius r in the first j segments and r - 1 in the others,
all up to distance m * (r - 1) + j + m - 1 has been seen. Small radii grow in all segments at once, larger
ones in one segment after the other. A code farther away than a query's k-th so far is left out inside
the join, and queries that are done leave.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm.shared import materialize, shared_dir

BITS = 64
NEIGHBOURS = 10
#: From this radius on segments grow one by one.
SINGLE = 4
#: Codes to which one value of a segment should lead.
LIST = 8
#: Index rows of a bucket.
BUCKET_ROWS = 500_000


def sign_code(vector: str) -> Column:
    """64-bit code of the signs of a vector of up to 64 numbers; null gives null, a missing or null number counts as not positive."""
    bits = [F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)).cast("long") for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return F.when(F.col(vector).isNotNull(), code)


def layout(codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments for a table of so many codes: widths near its logarithm, at most one apart."""
    n = min(16, max(2, round(BITS / math.log2(max(16, codes / LIST)))))
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def growth(segments: list[tuple[int, int]]) -> list[tuple[int, range]]:
    """Radius and the segments that grow to it, step by step, until every segment is covered whole."""
    n = len(segments)
    return [(r, some) for r in range(segments[0][1] + 1) for some in ([range(n)] if r < SINGLE else [range(s, s + 1) for s in range(n)])]


def _value(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _cut(code: str, segments: list[tuple[int, int]], some: range) -> Column:
    """One (segment, width, value) for each of ``some`` segments; inline it."""
    return F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(segments[s][1]).alias("width"), _value(F.col(code), *segments[s]).alias("value")) for s in some])


def _probes(waiting: DataFrame, segments: list[tuple[int, int]], some: range, radius: int) -> DataFrame:
    """All values at exactly ``radius`` bits from a query's segments: the bits are chosen one after the other, in order."""
    out = waiting.select("query_id", "query", "bound", F.inline(_cut("query", segments, some))).filter(F.col("width") >= radius).withColumn("bit", F.lit(-1))
    for i in range(radius):
        out = out.withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.col("width") - (radius - i))))
        out = out.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    return out.select("query_id", "query", "bound", "segment", "value")


def _write_index(codes: DataFrame, segments: list[tuple[int, int]]) -> str:
    """The bucketed table ``segment, value, code, ids``; returns its name."""
    spark, name = codes.sparkSession, f"hamming_index_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() * len(segments) // BUCKET_ROWS))
    rows = codes.select("code", "ids", F.inline(_cut("code", segments, range(len(segments))))).select("segment", "value", "code", "ids")
    rows.repartition(buckets, "segment", "value").write.format("parquet").bucketBy(buckets, "segment", "value").sortBy("segment", "value").saveAsTable(name, path=f"{shared_dir(spark).rstrip('/')}/{name}")
    return name


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest rows of each query, itself left out.

    ``rows`` and ``queries`` have ``id, code``; other columns are ignored. Ties go to the smaller id; fewer
    than k rows give fewer neighbours. Null codes and null ids are neither found nor searched; repeated rows
    count once; an empty table gives an empty result. Of equal codes only the k + 1 smallest ids can be an
    answer, so a code that very many rows share is met once.
    """
    rows = rows.filter("id is not null and code is not null").select("id", "code").distinct()
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k + 1)
    codes = materialize(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "search-codes")
    size = codes.agg(F.count("*").alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    segments = layout(size["codes"])
    own = codes.select(F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("own"))
    asked = queries.filter("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    wanted = F.least(F.lit(k), F.lit(size["ids"]) - F.coalesce("own", F.lit(0))).alias("wanted")
    waiting = materialize(asked.join(own, "query_id", "left").select("query_id", "query", wanted, F.lit(BITS).alias("bound")), "search-queries")
    table = _write_index(codes, segments)
    index = codes.sparkSession.table(table)
    apart = F.col("query").bitwiseXOR(F.col("code"))
    by_segment = [F.bit_count(_value(apart, *s)) for s in segments]
    key = ["query_id", "query"]
    nearest = Window.partitionBy(*key).orderBy("distance", "neighbor_id")
    best, done, steps = None, [], growth(segments)
    for step, (radius, some) in enumerate(steps):
        # a pair is met in every segment that is near enough: only the first of its nearest segments counts
        once = (F.least(*by_segment) == radius) & (F.array_position(F.array(*by_segment), F.lit(radius)) == F.col("segment") + 1)
        # there are far more probes than their plan's size tells, so no side may be broadcast
        met = _probes(waiting, segments, some, radius).join(index.hint("merge"), ["segment", "value"]).filter(once & (F.bit_count(apart) <= F.col("bound")))
        hits = met.select(*key, F.explode("ids").alias("neighbor_id"), F.bit_count(apart).alias("distance")).filter("neighbor_id <> query_id")
        pool = hits if best is None else hits.unionByName(best.drop("rank").join(waiting.select(*key), key, "left_semi"))
        best = materialize(pool.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k), f"search-best{step}")
        state = best.groupBy(*key).agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        full = F.coalesce(F.col("n"), F.lit(0)) >= F.col("wanted")
        ends = F.lit(step + 1 == len(steps)) | (F.col("wanted") <= 0) | (full & (F.col("kth") <= len(segments) * radius + some[-1]))
        judged = waiting.drop("bound").join(state, key, "left").select(*key, "wanted", F.when(full, F.col("kth")).otherwise(F.lit(BITS)).alias("bound"), ends.alias("ends"))
        judged = materialize(judged, f"search-state{step}")
        done.append(best.join(judged.filter("ends").select(*key), key, "left_semi"))
        waiting = judged.filter("not ends").drop("ends")
        if not waiting.limit(1).count():
            break
    codes.sparkSession.sql(f"DROP TABLE {table}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "neighbor_id", "distance")
