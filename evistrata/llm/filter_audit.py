"""How document filters interact: which one removes what, for every order in which they can be applied.

Every document's failures become a five-bit mask, in native expressions. Whether an earlier document has
the same text comes from the least id of each text. Documents are then counted by part and mask, 32 cells for each
part, and all that any order of the filters does follows from the cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm.shared import materialize

#: A filter's letter stands for the bit of its place here.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
_WORD, _MARKS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
_CELLS = 1 << len(FILTERS)
#: Null ids, which no label has, are dealt to so many keys before labels are joined.
_SPREAD = 1024


def own_mask(text: str = "text") -> Column:
    """Bits of the filters A to D, which look at one text only; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0))
    fails = (
        F.size(words) < MIN_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * MIN_DISTINCT_PERCENT,
        F.regexp_count(whole, F.lit("[A-Z]")).cast("long") * 100 > F.length(whole).cast("long") * MAX_UPPER_PERCENT,
        whole.rlike(_MARKS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every row: which filters it fails and what it is labelled.

    E holds where a smaller id has the same text (SHA-256) anywhere in the table. Rows with a null id have no smaller
    one and are nobody's smaller one, and no label; rows that repeat an id count each, and do not fail E by each other.
    Equal texts meet only as one least id for each task (partial sums); the join that marks the first of each text is by
    text and id, so no text is a hot key.
    """
    facts = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), own_mask().alias("own"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        ), "audit-facts",
    )
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("leads", F.lit(True))
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("spread")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(_SPREAD))).otherwise(0).cast("int")
    marked = facts.withColumn("spread", spread).join(told, ["doc_id", "spread"], "left").join(first.withColumn("spread", F.lit(0)), ["doc_id", "digest", "spread"], "left")
    again = F.col("doc_id").isNotNull() & F.col("leads").isNull()
    return marked.select("part", (F.col("own") + F.when(again, 1 << 4).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(marked: DataFrame) -> DataFrame:
    """``part`` with arrays ``n, good, toxic`` of 32 counts, one for each mask."""
    counted = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda m: F.coalesce(F.try_element_at(c, m), F.lit(0).cast("long")))
    by_mask = lambda c: F.map_from_entries(F.collect_list(F.struct("mask", c)))
    maps = counted.groupBy("part").agg(*[by_mask(c).alias(c) for c in ("n", "good", "toxic")])  # at most 32 entries each
    return maps.select("part", *[filled(F.col(c)).alias(c) for c in ("n", "good", "toxic")])


def _steps(spark) -> DataFrame:
    """All 600 steps: ``filter_order, step, prior, bit``; ``prior`` holds the bits of the filters before it."""
    rows = []
    for order in permutations(FILTERS):
        prior = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), i + 1, prior, bit))
            prior |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, prior int, bit int")


def enumerate_orders(table: DataFrame) -> DataFrame:
    """One row for each part, order and step from the cells of ``cells``.

    What a step does depends on its filter and on which filters came before, not on their order: each part has 80 such
    contexts, which are counted once and then dealt to the 600 steps. Over all orders a document with k failures is
    removed by each of them in 120 / k orders.
    """
    contexts = [(prior, 1 << f) for f in range(len(FILTERS)) for prior in range(_CELLS) if not prior >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(b).alias("bit")) for p, b in contexts])).alias("c")
    at = table.select("part", "n", "good", "toxic", each).select("part", "n", "good", "toxic", "c.*")

    def total(counts: str, weight) -> Column:
        pairs = F.zip_with(F.col(counts), F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda n, m: n * weight(m))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)

    yes = lambda c: F.when(c, 1).otherwise(0)
    prior, bit = F.col("prior"), F.col("bit")
    hit = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: yes(hit(m, bit) & ~hit(m, prior))
    orders = 120  # of five filters
    share = lambda m: F.when(hit(m, bit), F.lit(orders) / F.bit_count(m)).otherwise(0).cast("long")
    counted = at.select(
        "part", "prior", "bit", total("n", lambda m: yes(~hit(m, prior.bitwiseOR(bit)))).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: yes(hit(m, bit) & hit(m, prior))).alias("redundant"), total("n", lambda m: yes(m == bit)).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("n", share).alias("shapley"),
    )
    # the steps are 600 rows at every size of the input
    return counted.join(F.broadcast(_steps(table.sparkSession)), ["prior", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: documents kept, removed, redundant, failing this filter only, lost with good or toxic labels, and its Shapley sum.

    ``docs`` has ``doc_id, text, source`` and ``labels`` has ``doc_id, quality, toxic``; extra columns are ignored. Null text
    is empty text, a null source is the part '', where several labels name an id a 1 in any of them counts. An empty table has no part and
    gives an empty result; without labels the label counts are 0.
    """
    return enumerate_orders(cells(masks(docs, labels)))
