"""Helpers that several operators use: shared storage, batches of texts, sums of arrays, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evistrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once where whole texts go there; bounds its memory.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Send texts to Python workers in batches of at most ``rows`` and about ``size`` bytes, unless the session asks for less.

    A setting of the session, as the plans that need it run after the operator has returned.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if now is not None and not 0 < int(re.sub(r"\D", "", now) or 0) <= most:
            spark.conf.set(name, str(most))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def summed(parts: DataFrame, *by: str) -> DataFrame:
    """``by, pos, v``: arrays ``v`` of equal length added up place by place, in the JVM with partial sums."""
    return parts.select(*by, F.posexplode("v").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))


def text_size(text: str = "text"):
    """Number of maximal runs of characters that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols):
    """A reproducible number in [0, 1) from the hash of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


#: Edges that a task contracts at once; bounds its memory.
CONTRACT = 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (``a, b``) as stars: what a task can connect by itself is tied to its least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        seen, schema = 0, None

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def told() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(up)]
            tied = [(x, r) for x, r in pairs if x != r]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([t[i] for t in tied], schema.field(i).type) for i in (0, 1)], schema=schema)

        for b in batches:
            schema = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
            seen += b.num_rows
            if seen >= CONTRACT:
                yield told()
                seen = 0
        if schema is not None:
            yield told()

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``a``, ``b`` (comparable, not null). Returns ``node``, ``component``.
    Tasks contract their own edges to stars, then large-star and small-star steps alternate; every round
    is written to the shared folder, so lineage stays short. Rounds grow with the logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialize(_contracted(edges.select("a", "b").filter("a <> b")), "cc")
    state = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is tied to the least node around it
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours are tied to the least of them
        down = large.filter("a > b").repartition("a").dropDuplicates(["a", "b"])
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct(), "cc")
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (got["n"], got["h"]) == state:
            break
        state = (got["n"], got["h"])
    else:
        raise RuntimeError("connected components did not settle")
    tied = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return tied.union(roots.join(tied, "node", "left_anti"))
