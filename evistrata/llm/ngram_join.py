"""Exact n-gram Jaccard self-join: which documents are connected by links of a given similarity.

1. Shingles are counted in a table of hash slots whose size follows the input. Their global order is rare
   first by that count, then by hash; any order gives the same result, this one keeps passages that many
   documents share out of the prefixes.
2. Documents with equal sets form a class; only one of each class goes on.
3. Two sets that link share a shingle in their prefixes, at positions that leave enough shingles before
   and after it for a link.
4. Pairs from short lists are kept if the number of shared prefix shingles still allows a link, and are
   then verified on the whole sets.
5. Sets that meet in long lists (groups of near copies) are gathered to clusters, which are dealt out in
   blocks of bounded size. In a block the index lists are cut by size and by position, and blocks of a list
   from which no link can come are skipped. The answers of one set are derived from the computed answers of
   a highly similar set: only the shingles in which the two differ are looked up. Blocks give a spanning
   forest, never all pairs, and later rounds compare only sets that are not connected yet.
6. Connected components over the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm.exact_dedup import digest, keep_winners
from evistrata.llm.shared import connected_components, materialize, small_batches
from evistrata.llm.shingles import mix64, shingle_sets

WORDS = 4
PERCENT = 85
#: Bounds of the count table (powers of two; one byte for each slot is broadcast) and bytes of text for each slot.
LEAST_BITS, MOST_BITS, SLOT_BYTES = 16, 26, 2048
#: Slots that a task counts before it hands its counts on; bounds its memory.
PARTIAL = 1 << 22
#: Slots whose counts go in one row: as bytes for each slot, or with their places where few are counted.
ROW_SLOTS = 1 << 12
#: Longest posting list whose pairs are listed one by one.
SHORT_LIST = 32
#: A block of a cluster holds about this many shingles, each set counting 256 more.
BLOCK_SHINGLES = 600_000
#: Parts of a set in which the positions of an index list are blocked; share of a set by which one whose answers are derived may differ.
PARTS, DRIFT = 8, 0.05
#: Stands for a missing doc_id where texts are looked up.
NO_ID = -(1 << 63)


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of sizes ``a`` and ``b`` link."""
    return -(-percent * (a + b) // (100 + percent))


def packed_counts(slots: np.ndarray, n: np.ndarray) -> tuple[bytes | None, bytes]:
    """Counts of some slots of a row in the least width that holds them: for all slots (no places), or with the places of those counted."""
    width = np.min_scalar_type(int(n.max()))
    if len(n) * (2 + width.itemsize) < ROW_SLOTS * width.itemsize:
        return slots.astype(np.uint16).tobytes(), n.astype(width).tobytes()
    every = np.zeros(ROW_SLOTS, width)
    every[slots] = n
    return None, every.tobytes()


def add_counts(total: np.ndarray, places: bytes | None, counts: bytes) -> None:
    """Add what ``packed_counts`` gave to the counts of the row's slots."""
    where = slice(None) if places is None else np.frombuffer(places, np.uint16)
    size = ROW_SLOTS if places is None else len(where)
    total[where] += np.frombuffer(counts, np.dtype(f"u{len(counts) // size}")).astype(np.int64)


def shingle_ranks(docs: DataFrame, words: int) -> np.ndarray:
    """For each slot the logarithm (in quarters) of how many (document, distinct shingle) fall there, over all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // SLOT_BYTES).bit_length()))
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for s in shingle_sets(b["text"], words):
                held.append((s.view(np.uint64) >> shift).astype(np.int32))
                n += len(s)
                if n >= PARTIAL:
                    yield told(held)
                    held, n = [], 0
        yield told(held)

    def told(held: list[np.ndarray]) -> pd.DataFrame:
        slot, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int32), return_counts=True)
        parts, starts = np.unique(slot // ROW_SLOTS, return_index=True)
        rows = [(p, *packed_counts(slot[a:b] % ROW_SLOTS, n[a:b])) for p, a, b in zip(parts.tolist(), starts, [*starts[1:], len(slot)][: len(starts)], strict=True)]
        return pd.DataFrame(rows, columns=["part", "places", "counts"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(ROW_SLOTS, np.int64)

        def ended() -> pd.DataFrame:
            found = np.flatnonzero(total)
            return pd.DataFrame({"slot": (found + at * ROW_SLOTS).astype(np.int32), "n": total[found]})

        for b in batches:
            for part, places, counts in zip(b["part"], b["places"], b["counts"], strict=True):
                if part != at:
                    if at is not None:
                        yield ended()
                    at, total = part, np.zeros(ROW_SLOTS, np.int64)
                add_counts(total, places, counts)
        if at is not None:
            yield ended()

    packed = docs.select("text").mapInPandas(run, "part int, places binary, counts binary")
    counted = packed.repartition("part").sortWithinPartitions("part").mapInPandas(summed, "slot int, n long")
    # quiet slots stay 0 here, so that only slots above the mean go to the driver, one byte each
    rank = F.ceil(4 * F.log2(1 + F.col("n"))).cast("int").alias("rank")
    counted = materialize(counted.select("slot", rank), "join-slots")
    usual = counted.agg(F.avg("rank")).first()[0] or 0
    ranks = np.zeros(1 << bits, np.uint8)
    louder = counted.filter(F.col("rank") > usual).groupBy("rank").agg(F.collect_list("slot").alias("slots"))
    for r in louder.toLocalIterator():
        ranks[np.asarray(r["slots"], np.int64)] = r["rank"]
    return ranks


def fingerprints(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n, k1, k2, prefix``: set size, 128-bit fingerprint of the set, and its first shingles in global order; a column ``digest`` of ``docs`` goes along."""
    table = shingle_ranks(docs, words)
    ranks = docs.sparkSession.sparkContext.broadcast(table)  # at most 2 ** MOST_BITS bytes
    shift = np.uint64(64 - (len(table) - 1).bit_length())

    def one(s: np.ndarray) -> tuple[int, int, int, np.ndarray]:
        u = s.view(np.uint64)
        order = np.lexsort((u, ranks.value[(u >> shift).astype(np.int64)]))
        first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
        return len(s), *set_keys(s), s[order[:first]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(s) for s in shingle_sets(b["text"], words)]
            yield pd.DataFrame({c: b[c] for c in kept} | {"n": [g[0] for g in got], "k1": [g[1] for g in got], "k2": [g[2] for g in got], "prefix": [g[3] for g in got]})

    kept = ["doc_id", *(c for c in docs.columns if c == "digest")]
    schema = "doc_id bigint, " + ("digest string, " if len(kept) > 1 else "") + "n long, k1 bigint, k2 bigint, prefix array<bigint>"
    return docs.select(*kept, "text").mapInPandas(run, schema)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set as two signed numbers."""
    with np.errstate(over="ignore"):
        u = s.view(np.uint64)
        k1, k2 = (np.array([k], np.uint64).view(np.int64)[0] for k in (np.add.reduce(u), np.add.reduce(mix64(u ^ np.uint64(0x5851F42D4C957F2D)))))
    return k1, k2


def set_classes(prints: DataFrame) -> DataFrame:
    """``cid, k1, k2, rep, copies, n, prefix``: one row per distinct set; ``rep`` is the smallest doc_id, null if none has one.

    Copies meet in partial aggregates. ``cid`` is ``k1``; should sets share it, the later ones count up from it.
    """
    classes = prints.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = materialize(classes, "join-classes")
    if not classes.groupBy("k1").count().filter("count > 1").limit(1).count():
        return classes.withColumn("cid", F.col("k1"))
    turn = F.row_number().over(Window.partitionBy("k1").orderBy("k2")) - 1
    return materialize(classes.withColumn("cid", F.col("k1") + turn), "join-classes-told-apart")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cid, shingles`` for the classes in ``wanted`` (``cid, k1, k2, doc_id``), one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], words))
            keys = [set_keys(s) for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "shingles": sets})

    ids = wanted.select("doc_id").distinct()
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    found = texts.mapInPandas(run, "doc_id bigint, k1 bigint, k2 bigint, shingles array<bigint>")
    return found.join(wanted, ["doc_id", "k1", "k2"]).dropDuplicates(["cid"]).select("cid", "shingles")


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, na, nb, c`` of short lists, with the number of prefix shingles that they share there."""
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent}.0)"
    fits = f"100 * x.n >= {percent} * y.n and x.cid <> y.cid and least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= {need}"
    lists = postings.filter(F.col("length") <= SHORT_LIST).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "cid", "pos"))).alias("l"))
    # entries are ordered by size, so an entry's partners end where the sizes become too large
    pairs = lists.select(F.explode(F.expr(f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), y -> {fits}), y -> struct(x.cid as a, y.cid as b, x.n as na, y.n as nb))))")).alias("p"))
    low = F.col("p.a") < F.col("p.b")
    ordered = pairs.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"), F.when(low, F.col("p.na")).otherwise(F.col("p.nb")).alias("na"), F.when(low, F.col("p.nb")).otherwise(F.col("p.na")).alias("nb"))
    return ordered.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def link_block(ids: np.ndarray, sets: list[np.ndarray], known: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect members of ``left`` with members of ``right`` (boolean masks over the sets).

    ``known`` has the component that each set is already in. Only links that connect what is not
    connected yet are returned, so there are fewer than sets.
    """
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, known, left, right = ids[order], known[order], left[order], right[order]
    sets = [sets[i] for i in order]
    n = np.array([len(s) for s in sets], np.int64)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(flat.ravel(), np.cumsum(n)[:-1])
    # index over the right side: lists cut into blocks by size class and by position in the set
    member = np.repeat(np.arange(len(sets)), n)
    place = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    keep = right[member]
    band = np.floor(np.log(np.maximum(n, 1)) / -np.log(percent / 100)).astype(np.int64)
    band -= band.min()
    bands = int(band.max()) + 1
    part = place * PARTS // n[member]
    code = (flat.ravel() * bands + band[member]) * PARTS + part
    at = np.lexsort((member[keep], code[keep]))
    entries = member[keep][at]
    pointer = np.searchsorted(code[keep][at], np.arange(len(tokens) * bands * PARTS + 1))
    least, most = np.full(bands, 1 << 40), np.zeros(bands, np.int64)
    np.minimum.at(least, band, n)
    np.maximum.at(most, band, n)

    def overlaps(some: np.ndarray, where: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
        """How many of the shingles ``some``, at ``where`` in a set of ``size``, the indexed sets have, for all that can link.

        With a shingle at p of n and at q of m two sets share at most min(p, q) + min(n - p, m - q); blocks
        of a list from which less than the needed overlap, less ``DRIFT`` of the set, can come are skipped.
        """
        b, q = np.arange(low, high + 1), np.arange(PARTS)
        far, near = (q + 1) * most[b][:, None] // PARTS, q * least[b][:, None] // PARTS
        bound = np.minimum(where[:, None, None], far) + np.minimum(size - where[:, None, None], most[b][:, None] - near)
        need = percent * (size + least[b][:, None]) / (100 + percent) - DRIFT * size
        t, b_, q_ = np.nonzero(bound >= need)
        key = (some[t] * bands + low + b_) * PARTS + q_
        start, stop = pointer[key], pointer[key + 1]
        length = stop - start
        run = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(entries[run], minlength=len(sets))

    def overlaps_of(some: np.ndarray, low: int, high: int) -> np.ndarray:
        start, stop = pointer[(some * bands + low) * PARTS], pointer[(some * bands + high + 1) * PARTS]
        length = stop - start
        run = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(entries[run], minlength=len(sets))

    forest = _Forest(len(sets))
    first: dict[int, int] = {}
    for i, k in enumerate(known.tolist()):
        forest.join(first.setdefault(k, i), i)
    answers: dict[int, tuple[int, int, int, np.ndarray, float]] = {}  # by root: a set, the blocks it has seen, its overlaps, room for drift
    links = []
    for y in np.flatnonzero(left).tolist():
        low, high = max(0, int(band[y]) - 1), min(bands - 1, int(band[y]) + 1)
        lo, hi = np.searchsorted(n, [-(-percent * n[y] // 100), n[y] * 100 // percent + 1])
        roots = {forest.root(j) for j in np.flatnonzero(right[lo:hi]) + lo} if hi - lo <= 64 else None
        if roots is not None and roots <= {forest.root(y)}:
            continue
        derived, got, room = answers.get(forest.root(y)), None, DRIFT * n[y] / 2
        if derived and derived[1] <= low and derived[2] >= high:
            x, low_, high_, seen, left_over = derived
            more, less = np.setdiff1d(of[y], of[x], True), np.setdiff1d(of[x], of[y], True)
            if len(more) + len(less) <= left_over:
                low, high, room = low_, high_, left_over - len(more) - len(less)
                # the looked-up differences count for every set, wherever they stand in it
                got = seen + overlaps_of(more, low, high) - overlaps_of(less, low, high)
        if got is None:
            got = overlaps(of[y], np.arange(n[y]), int(n[y]), low, high)
        hits = np.flatnonzero(right[lo:hi] & (100 * got[lo:hi] >= percent * (n[y] + n[lo:hi] - got[lo:hi]))) + lo
        for j in hits.tolist():
            if j != y and forest.join(y, j):
                links.append((int(ids[y]), int(ids[j])))
        answers[forest.root(y)] = (y, low, high, got, room)
    return links


def _compare(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` in each ``task``; ``side`` is 0 for the left, 1 for the right, 2 for both."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        side = g["side"].to_numpy()
        links = link_block(g["cid"].to_numpy(), [np.asarray(s) for s in g["shingles"]], g["known"].to_numpy(), side != 1, side != 0, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return members.groupBy("task").applyInPandas(run, "a bigint, b bigint")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Deal the sets of a cluster (``cid, n, cluster``) out by size class and hash to blocks of about the same bounded size.

    Adds ``band``, in which sizes differ by less than a link allows, and ``block``, unique in the cluster.
    """
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)))
    totals = members.groupBy("cluster", "band").agg(F.ceil(F.sum(F.col("n") + 256) / BLOCK_SHINGLES).alias("blocks"))
    block = F.col("band") * (1 << 32) + F.pmod(F.xxhash64("cid"), F.col("blocks"))
    return members.join(totals, ["cluster", "band"]).withColumn("block", block).drop("blocks")


def _known(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component ``known`` that each is in by now."""
    tied = materialize(connected_components(links), "join-known").withColumnRenamed("node", "cid")
    return members.join(tied, "cid", "left").withColumn("known", F.coalesce("component", "cid")).drop("component")


def _cluster_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside clusters (``cid, n, cluster``): within blocks first, then by delegates, then what is left across blocks."""
    names = materialize(_blocks(clusters, percent), "join-blocks")
    within = names.select("cid", F.col("cid").alias("known"), F.lit(2).alias("side"), F.struct("cluster", "block").alias("task"))
    links = materialize(_compare(within.join(sets, "cid"), percent), "join-within")
    several = names.groupBy("cluster").agg((F.min("block") < F.max("block")).alias("several")).filter("several").select("cluster")
    if not several.limit(1).count():
        return links
    wide = materialize(_known(names.join(several, "cluster"), links), "join-wide")
    # one delegate for every component in a block, compared in blocks of their own
    delegates = wide.groupBy("cluster", "block", "known").agg(F.max_by("cid", "n").alias("cid"), F.max("n").alias("n"))
    met = _blocks(delegates.drop("block"), percent).select("cid", "known", F.lit(2).alias("side"), F.struct("cluster", "block").alias("task"))
    links = materialize(links.union(_compare(met.join(sets, "cid"), percent)), "join-delegates")
    wide = materialize(_known(wide.drop("known"), links), "join-wide2")
    # across two blocks, a set needs to meet the other block unless all of it is in the set's component
    whole = wide.groupBy("cluster", "band", "block").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    one = whole.select("cluster", F.explode(F.array("band", F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}1") for c in ("block", "lo", "hi", "n_lo", "n_hi")])
    two = whole.select("cluster", "band", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "n_lo", "n_hi")])
    apart = ~((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2")))
    near = (100 * F.col("n_hi1") >= percent * F.col("n_lo2")) & (100 * F.col("n_hi2") >= percent * F.col("n_lo1"))
    tasks = materialize(one.join(two, ["cluster", "band"]).filter((F.col("block1") < F.col("block2")) & apart & near).drop("band"), "join-tasks")
    if not tasks.limit(1).count():
        return links
    odd = lambda o: ~((F.col(f"lo{o}") == F.col(f"hi{o}")) & (F.col("known") == F.col(f"lo{o}")))
    # a left set that already belongs to the one component of the other block has nothing to find there
    sides = [
        wide.join(tasks.withColumn("block", F.col(f"block{s + 1}")), ["cluster", "block"]).filter(odd(2 - s)).select("cid", "known", F.lit(s).alias("side"), F.struct("cluster", "block1", "block2").alias("task"))
        for s in (0, 1)
    ]
    return links.union(_compare(sides[0].union(sides[1]).join(sets, "cid"), percent))


def _joined(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows of ``docs`` (``doc_id, text``), and ``k1, k2, component, component_id`` of the sets that others link with or repeat."""
    small_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs, words, percent), "join-prints")
    classes = set_classes(prints)
    exploded = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared_tokens = exploded.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    postings = materialize(exploded.join(shared_tokens.hint("merge"), "token"), "join-postings")
    long = postings.filter(F.col("length") > SHORT_LIST)
    # what long lists may add to the shared shingles of a pair
    shared = materialize(long.groupBy("cid").agg(F.count("*").alias("g")), "join-long")
    clusters = None
    if shared.limit(1).count():
        stars = long.join(long.groupBy("token").agg(F.min("cid").alias("b")), "token").select(F.col("cid").alias("a"), "b")
        tied = connected_components(stars).withColumnRenamed("node", "cid").withColumnRenamed("component", "cluster")
        clusters = materialize(tied.join(classes.select("cid", "n"), "cid"), "join-clusters")
    pairs = materialize(_pairs(postings, percent), "join-candidates")
    for side in ("a", "b"):
        pairs = pairs.join(shared.select(F.col("cid").alias(side), F.col("g").alias(f"g{side}")), side, "left").fillna(0, [f"g{side}"])
        if clusters is not None:
            pairs = pairs.join(clusters.select(F.col("cid").alias(side), F.col("cluster").alias(f"cluster_{side}")), side, "left")
    rest = F.greatest(*[F.ceil(F.col(x) * percent / 100) - 1 for x in ("na", "nb")])
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    pairs = pairs.filter(F.col("c") + F.least("ga", "gb") + rest >= need)
    if clusters is not None:
        pairs = pairs.filter("cluster_a is null or cluster_b is null or cluster_a <> cluster_b")
    pairs = materialize(pairs.select("a", "b", "na", "nb"), "join-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    if clusters is not None:
        wanted = wanted.union(clusters.select("cid"))
    wanted = materialize(classes.select("cid", "k1", "k2", F.coalesce("rep", F.lit(NO_ID)).alias("doc_id")).join(wanted.distinct(), "cid", "left_semi"), "join-wanted")
    sets = materialize(whole_sets(docs, wanted, words), "join-sets")
    checked = pairs.join(sets.withColumnRenamed("cid", "a").withColumnRenamed("shingles", "sa"), "a").join(sets.withColumnRenamed("cid", "b").withColumnRenamed("shingles", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = checked.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    if clusters is not None:
        links = links.union(_cluster_links(clusters, sets, percent))
    tied = materialize(connected_components(materialize(links, "join-links")), "join-components").withColumnRenamed("node", "cid")
    grouped = classes.select("cid", "k1", "k2", "rep", "copies").join(tied, "cid", "left").filter("component is not null or copies > 1").withColumn("component", F.coalesce("component", "cid"))
    grouped = materialize(grouped, "join-grouped")
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints, materialize(grouped.join(least, "component").select("k1", "k2", "component", "component_id"), "join-lookup")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    A document's set is that of its distinct ``words``-word shingles, A-Z lower-cased; a shorter text is
    one shingle. Two documents link when ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest doc_id that links reach, the document's own included. Null texts and texts without
    words have an empty set and link with nothing. Equal sets always link. Rows with a null doc_id link
    like any other, but give no component its id (null if none has one). Repeated rows are returned
    each; an empty table gives an empty result; extra columns are ignored. Shingles are compared by
    64-bit hashes and equal sets found by 128-bit fingerprints.
    """
    prints, lookup = _joined(docs.select("doc_id", "text"), words, percent)
    keys = [F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("k1", "k2")]
    found = prints.select("doc_id", "n", *keys).join(lookup, ["k1", "k2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose group another document stands for; columns as they came.

    The row with the smallest doc_id of a group stays (null ids come last; of several texts with that id,
    the one whose digest is least). Rows without words stay. Rows are told apart by doc_id and text, so
    another row with the id of one that goes is not touched. Of equal rows of which one stays, one stays.
    """
    prints, lookup = _joined(docs.select("doc_id", "text", digest("text").alias("digest")), words, percent)
    rows = prints.filter("n > 0").groupBy("k1", "k2", F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("n"))
    units = materialize(rows.join(lookup, ["k1", "k2"]).select("component", "id", "digest", "n"), "join-units")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    heads = units.groupBy("component").agg(F.min(rank).alias("head"))
    decided = units.join(heads, "component").select("id", "digest", "n", (F.col("head") == rank).alias("wins"))
    return keep_winners(docs, decided)
