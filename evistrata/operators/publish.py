"""Several tables written in one publication: all parts of a batch become visible at once, or none.

Parts are written to folders that no reader knows. A manifest that names the folders of every table is then put in place
under the next version number by one atomic step, and readers take the newest manifest. Two writers can't take the same
number: the second starts from the newer manifest, or is refused if it has read what changed. A batch that is
in the manifest is not written again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class Conflict(Exception):
    """Another publication changed what this one was made from."""


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with all its content, or tell that the path is taken; atomic against other writers."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":  # renaming would replace; a link does not
        try:
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(temporary, False)
    # a rename onto a file that exists is refused by the store
    done = not fs.exists(target) and fs.rename(temporary, target)
    if not done:
        fs.delete(temporary, False)
    return done


def read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none where it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


@dataclass(frozen=True)
class Table:
    """How a table is kept.

    Without ``keys`` rows are only added. With them a row replaces the one with the same keys, and a row whose column
    ``deleted`` is true takes it away. Rows lie in ``buckets`` folders by ``dealt_by`` (the first key by default),
    so that who asks for some of its values reads their buckets only.
    """

    schema: str
    keys: tuple[str, ...] = ()
    dealt_by: str | None = None
    buckets: int = 16


class Publication:
    """Tables below ``root`` that are published together."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]) -> None:
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def manifest(self) -> dict:
        """The newest manifest: ``version``, the folders of each table with the version that added them, the batches told."""
        known = [n for n in names_in(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.root}/manifests/{known[-1]}")) if known else {"version": 0, "tables": {}, "batches": []}

    def _bucket(self, name: str) -> Column:
        t = self.tables[name]
        return F.pmod(F.xxhash64(F.col(t.dealt_by or (t.keys[0] if t.keys else t.schema.split()[0])).cast("string")), F.lit(t.buckets)).cast("int")

    def publish(self, batch: str, parts: Sequence[tuple[str, DataFrame | Callable[[], DataFrame]]], read: int | None = None) -> int:
        """Write ``parts`` (table and rows) and make them visible together; the version that holds the batch.

        A batch that is published already is left as it is. With ``read``, the version that the rows were made from, a
        publication that came between raises ``Conflict``.
        """
        base = self.manifest()
        if batch in base["batches"]:
            return base["version"]
        if read is not None and base["version"] != read:
            raise Conflict(f"version {base['version']} instead of {read}")
        attempt, added = uuid.uuid4().hex, {}
        for i, (name, rows) in enumerate(parts):
            rows = rows() if callable(rows) else rows
            path = f"{self.root}/data/{name}/{attempt}-{i}"
            wanted = rows.select(*[c for c in self._schema(name).names if c in rows.columns])
            wanted.withColumn("bucket", self._bucket(name)).repartition(self.tables[name].buckets, "bucket").write.partitionBy("bucket").parquet(path)
            added.setdefault(name, []).append(path)
        while True:
            version = base["version"] + 1
            tables = {n: base["tables"].get(n, []) + [[p, version, i] for i, p in enumerate(added.get(n, []))] for n in {*base["tables"], *added}}
            told = {"version": version, "tables": tables, "batches": [*base["batches"], batch]}
            if put_once(self.spark, f"{self.root}/manifests/{version:012d}.json", json.dumps(told)):
                return version
            base = self.manifest()
            if batch in base["batches"]:
                return base["version"]
            if read is not None:
                raise Conflict(f"version {base['version']} instead of {read}")

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(self.tables[name].schema + ", deleted boolean" if self.tables[name].keys else self.tables[name].schema)

    def read(self, name: str, only: DataFrame | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a table as the newest manifest (or ``manifest``) has them.

        ``only`` holds values of the column that the table is dealt by: just their buckets are read and just their rows given. The
        numbers of the buckets, never the values, come to the driver.
        """
        t, schema = self.tables[name], self._schema(name)
        entries = (manifest or self.manifest())["tables"].get(name, [])
        dealt = t.dealt_by or (t.keys[0] if t.keys else schema.names[0])
        wanted = None if only is None else sorted(r[0] for r in only.select(F.pmod(F.xxhash64(F.col(dealt).cast("string")), F.lit(t.buckets)).cast("int")).distinct().collect())
        stored = StructType([*schema.fields, StructField("bucket", LongType())])
        rows = self.spark.createDataFrame([], StructType([*schema.fields, StructField("_at", LongType())]))
        for order, (path, _, _) in enumerate(entries):
            part = self.spark.read.schema(stored).option("basePath", path).parquet(path)
            part = part if wanted is None else part.filter(F.col("bucket").isin(*wanted) if wanted else F.lit(False))
            rows = rows.unionByName(part.drop("bucket").withColumn("_at", F.lit(order).cast("long")))
        if only is not None:
            rows = rows.join(only.select(dealt).distinct(), dealt, "left_semi")
        if not t.keys:
            return rows.select(*schema.names)
        rest = [c for c in schema.names if c not in t.keys]
        newest = rows.groupBy(*t.keys).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(*t.keys, "_r.*")
        return newest.filter(~F.coalesce("deleted", F.lit(False))).select(*[c for c in schema.names if c != "deleted"])

    def compact(self, name: str) -> int:
        """Write the rows of a table anew as one folder; readers of older manifests are not disturbed."""
        base = self.manifest()
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}-0"
        self.read(name, manifest=base).withColumn("bucket", self._bucket(name)).repartition(self.tables[name].buckets, "bucket").write.partitionBy("bucket").parquet(path)
        version = base["version"] + 1
        told = {"version": version, "tables": base["tables"] | {name: [[path, version, 0]]}, "batches": base["batches"]}
        if not put_once(self.spark, f"{self.root}/manifests/{version:012d}.json", json.dumps(told)):
            raise Conflict("a publication came between")
        return version
