"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by the SHA-256 of the text.
A batch is reduced to one winner per digest before anything is shuffled by digest, and the winners
that the index lacks are found by a sort-merge anti-join that reads the index in its bucket order, so
the index itself is never shuffled. Those winners are then appended, and what stays is read back from the
index. A whole table goes through it in batches of falling ids. DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.llm.shared import materialize, shared_dir, spare_names

#: Rows of a bucket for which an index is laid out.
BUCKET_ROWS = 2_000_000
#: Batches in which a whole table meets a new index.
BATCHES = 2
#: Repeated rows are written out in runs of at most this many.
RUN = 4096


class DigestIndex:
    """A bucketed table ``digest, keep_id, batch``; reopened by giving the same name and path.

    Every append adds a file to each bucket; ``compact`` writes the buckets anew as one file each.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None) -> None:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        self.spark, self.name, self.path, self.buckets = spark, name, path, int(told["Num Buckets"])

    @classmethod
    def fresh(cls, spark: SparkSession, rows: int = 0) -> DigestIndex:
        """A new index for about ``rows`` texts, with as many buckets at least as the session's shuffles have partitions."""
        tag = uuid.uuid4().hex
        return cls(spark, f"digest_index_{tag}", f"{shared_dir(spark).rstrip('/')}/digest-index-{tag}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows read without their buckets."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def unseen(self, winners: DataFrame) -> DataFrame:
        """The winners whose digest the index lacks."""
        return winners.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def append(self, winners: DataFrame, batch: str) -> None:
        """Add ``digest, keep_id`` rows that are not there yet, bucketed and sorted."""
        self._write(winners.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch")))

    def _write(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, path=self.path)

    def compact(self) -> DigestIndex:
        """The same rows in a new index with one file per bucket; this one's table is dropped."""
        tag = uuid.uuid4().hex
        new = DigestIndex(self.spark, f"{self.name}_{tag}", f"{self.path.rstrip('/')}-{tag}", self.buckets)
        new._write(self.files())
        self.drop()
        return new

    def drop(self) -> None:
        """Forget the table; its files stay in the shared folder until that is cleared."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest(text: str = "text") -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest, id, n``: equal rows become one with a count before they meet, so repeated rows are no hot key."""
    return materialize(docs.select(digest(text_col).alias("digest"), F.col(id_col).alias("id")).groupBy("digest", "id").agg(F.count("*").alias("n")), "digest-units")


def _admit(units: DataFrame, index: DigestIndex, batch: str) -> None:
    """Append the largest id of each digest that the index lacks."""
    winners = materialize(units.groupBy("digest").agg(F.max("id").alias("keep_id")), "digest-winners")
    index.append(materialize(index.unseen(winners), "digest-new"), batch)


def _decide(units: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """``digest, id, n, keep_id, group_size, wins``: what the index says of each unit.

    A unit wins if the index keeps its id since one of ``batches``. The files of the index are read
    without their buckets, so a digest with very many ids can be split between tasks.
    """
    sizes = units.groupBy("digest").agg(F.sum("n").alias("group_size"))
    facts = materialize(sizes.join(index.files(), "digest"), "digest-facts")
    wins = F.col("batch").isin(*batches) & F.col("id").eqNullSafe(F.col("keep_id"))
    return units.join(facts.hint("merge"), "digest").select("digest", "id", "n", "keep_id", "group_size", wins.alias("wins"))


def _row_by_row(decided: DataFrame, id_col: str) -> DataFrame:
    """As many rows as there were; of those that repeat a winner the first is kept."""
    runs = decided.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))))
    last = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN).cast("int")
    rows = runs.withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    return rows.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", (F.col("wins") & (F.col("run") == 0) & (F.col("at") == 1)).alias("kept"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append what is new to ``index`` and decide every row of ``docs`` by it.

    One row per input row: ``id_col, digest, keep_id, group_size, kept``. Of equal texts the largest id
    stays (null ids rank lowest), unless the index knew the text already: then ``keep_id`` is the id
    known there and nothing of the batch stays. Null text counts as empty text; an empty table gives an
    empty result. Rows repeated with the same id and text are counted, and exactly one of them stays.
    Extra columns of ``docs`` are ignored. A batch that is run again gets the same answer.
    """
    units = _units(docs, id_col, text_col)
    _admit(units, index, batch)
    return _row_by_row(_decide(units, index, [batch]), id_col)


def _in_batches(units: DataFrame, index: DigestIndex, batches: int) -> list[str]:
    """Let ``units`` meet the index in batches of falling ids, so that what the index keeps is the largest id of all."""
    cuts = units.agg(F.percentile_approx("id", [1 - (i + 1) / batches for i in range(batches - 1)])).first()[0] if batches > 1 else []
    names, above = [], None
    for i, cut in enumerate([*(cuts or []), None]):
        part = units if above is None else units.filter(F.col("id").isNull() | (F.col("id") <= above))
        _admit(part if cut is None else part.filter(F.col("id") > cut), index, f"part-{i}")
        names.append(f"part-{i}")
        above = cut if cut is not None else above
    return names


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """A whole table decided by a new index that it passes in ``batches``; the result is that of ``dedup_batch``. Ids are numbers."""
    units = _units(docs, id_col, text_col)
    index = DigestIndex.fresh(docs.sparkSession, units.count())
    decided = _decide(units, index, _in_batches(units, index, batches))
    index.drop()
    return _row_by_row(decided, id_col)


def keep_winners(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that lost; columns as they came.

    ``decided`` has one row for each (``id``, ``digest``) that is judged, with its number ``n`` of rows and
    whether it ``wins``; rows that it does not name stay. Losers are taken away by an anti-join. There may
    be as many as documents, so it is a sort-merge join at every size. Of ``n`` equal rows that win one stays.
    """
    key, sha = spare_names(docs, "dedup_id", "dedup_digest")
    named = lambda d: d.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias(key), F.col("digest").alias(sha))
    losers = materialize(named(decided.filter("not wins or n > 1")), "digest-losers")
    again = materialize(named(decided.filter("wins and n > 1")), "digest-again")
    tagged = docs.withColumns({key: F.coalesce(F.col(id_col).cast("string"), F.lit("")), sha: digest(text_col)})
    out = tagged.join(losers.hint("merge"), [key, sha], "left_anti")
    if again.limit(1).count():
        out = out.unionByName(tagged.join(again, [key, sha], "left_semi").dropDuplicates([key, sha]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; columns as they came. Where equal rows repeat the winner, one of them stays."""
    units = _units(docs, id_col, text_col)
    index = DigestIndex.fresh(docs.sparkSession, units.count())
    decided = _decide(units, index, _in_batches(units, index, batches))
    index.drop()
    return keep_winners(docs, decided, id_col, text_col)
