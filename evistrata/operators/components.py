"""Connected components, of a whole graph and of one that grows by batches.

Over a whole graph tasks first tie what they can connect by themselves to its least node. A node that one such part knows follows that least node and
takes no part in what comes then; nodes of several parts are the core. In it every node hands its greater neighbours, and after that its smaller ones, to
the least node around it, until nothing moves: rounds grow with the logarithm of the longest path.

A graph that grows keeps its labels. A batch of edges is lifted to the labels of its ends, only those few labels are connected, and
only nodes of the components that met get another label. What met is told, as it joins entities that were stored apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.operators.lineage import written
from evistrata.operators.publish import Publication, Table

#: Edges that a task ties at once; bounds its memory.
TIED = 200_000


def _tied(edges: DataFrame) -> DataFrame:
    """``a, b`` with every node of a part of the edges, once, pointing to the least that the part connects it with (itself, if it is that)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}

        def find(x):
            path = []
            while (up := least.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for p in path:
                least[p] = x
            return x

        def told(schema) -> pa.RecordBatch:
            ends = [(x, find(x)) for x in [*least]]
            least.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], schema.field(i).type) for i in (0, 1)], schema=schema)

        schema, held = None, 0
        for batch in batches:
            schema, held = batch.schema, held + batch.num_rows
            for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                a, b = sorted((find(a), find(b)))
                least[b] = a
            if held >= TIED:
                yield told(schema)
                held = 0
        if schema is not None:
            yield told(schema)

    return edges.mapInArrow(run, edges.schema)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` (``a, b``, not null) is connected with; its own for one that is tied to itself only."""
    tied = written(_tied(edges.select("a", "b").filter("a is not null and b is not null")), "tied")
    nodes = written(tied.groupBy("a").agg(F.count("*").alias("parts"), F.min("b").alias("up")), "nodes")
    # only nodes of several parts connect them
    core = tied.join(nodes.filter("parts > 1").select("a"), "a", "left_semi").filter("a <> b")
    stars, before = written(core.distinct(), "core"), None
    for _ in range(most_rounds):
        around = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # greater neighbours go to the least node around
        up = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        # then each node and its smaller neighbours go to the least of them
        low = up.groupBy("a").agg(F.min("b").alias("least"))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(low.select("a", F.col("least").alias("b")))
        stars = written(down.filter("a <> b").distinct(), "stars")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    labels = stars.select(F.col("a").alias("up"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("up"), F.col("b").alias("component"))).groupBy("up").agg(F.min("component").alias("component"))
    return nodes.join(labels, "up", "left").select(F.col("a").alias("node"), F.coalesce("component", "up").alias("component"))


LABELS = {"labels": Table("node string, component string", ("node",)), "members": Table("component string, node string", ("component", "node"), "component")}


def store(spark: SparkSession, root: str) -> Publication:
    """Stored labels by node, and the nodes of each component."""
    return Publication(spark, root, LABELS)


def grow(kept: Publication, batch: str, edges: DataFrame) -> DataFrame:
    """Add a batch of edges (``a, b``, texts) to stored labels; gives ``component, merged_into`` of the stored components that met.

    Batches in any order lead to the labels of one run over all edges. Labels are read for the ends of the batch only, members for the components that
    met only. A batch that is published already changes nothing and gives no row.
    """
    base = kept.manifest()
    spark = edges.sparkSession
    none = spark.createDataFrame([], "component string, merged_into string")
    if batch in base["batches"]:
        return none
    edges = written(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a is not null and b is not null").distinct(), "new-edges")
    ends = written(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "ends")
    known = kept.read("labels", ends, base)
    labelled = written(ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("label"), F.col("component").isNotNull().alias("stored")), "labelled")
    of = lambda end: labelled.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    lifted = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    root = written(connected(lifted).select(F.col("node").alias("label"), F.col("component").alias("root")), "roots")
    met = written(labelled.filter("stored").select("label").distinct().join(root, "label").filter("label <> root").select(F.col("label").alias("component"), F.col("root").alias("merged_into")), "met")
    moved = kept.read("members", met.select("component"), base).join(met, "component")
    fresh = labelled.filter("not stored").join(root, "label").select("node", F.col("root").alias("component"))
    # a component whose name is a new, smaller node is a stored one under another name: it moves too, but it did not meet another
    labels = fresh.unionByName(moved.select("node", F.col("merged_into").alias("component")))
    members = labels.select("component", "node").withColumn("deleted", F.lit(False)).unionByName(moved.select("component", "node").withColumn("deleted", F.lit(True)))
    # several stored components under one root have met; one that only got a smaller name has not
    stored = labelled.filter("stored").select("label").distinct().join(root, "label").groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("merged_into"))
    told = written(labelled.filter("stored").select("label").distinct().join(root, "label").select(F.col("label").alias("component"), F.col("root").alias("merged_into")).join(stored, "merged_into", "left_semi").select("component", "merged_into"), "merges")
    kept.publish(batch, [("labels", labels), ("members", members)], read=base["version"])
    return told
