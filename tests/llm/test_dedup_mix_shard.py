import hashlib
import random
from collections import Counter, defaultdict

import pytest

from evistrata.llm import exact_dedup, mixing, ngram_join, sharding, surrogates


def test_dedup_matches_brute_force(spark, awkward, empty):
    got = exact_dedup.dedup_batch(awkward, exact_dedup.DigestIndex.fresh(spark), "b").collect()
    groups = defaultdict(list)
    for r in awkward.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert len(got) == 10 and sum(r.kept for r in got) == len(groups)
    for r in got:
        ids = [i for i in groups[r.digest] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[r.digest]))
        assert not r.kept or r.doc_id == r.keep_id
    assert exact_dedup.dedup_batch(empty, exact_dedup.DigestIndex.fresh(spark), "b").count() == 0
    assert exact_dedup.drop_copies(awkward).count() == len(groups)
    assert exact_dedup.drop_copies(awkward).columns == awkward.columns


def test_index_persists_between_batches(spark):
    index = exact_dedup.DigestIndex.fresh(spark)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.dedup_batch(make([(1, "a"), (2, "a"), (3, "b")]), index, "first").collect()
    again = exact_dedup.DigestIndex(spark, index.name, index.path)
    got = {(r.doc_id): (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(make([(9, "a"), (8, "c"), (7, "c")]), again, "second").collect()}
    assert got == {9: (2, False), 8: (8, True), 7: (8, False)}
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 8]
    plan = again.unseen(make([(1, "x")]).selectExpr("sha2(text, 256) digest", "doc_id keep_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in fixed) for s in names if s not in fixed}
        over = [s for s in share if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), rng.choice(["a", "b", "c", "d", None, "Z", "é"]) if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    expected = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * expected[r.source]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 60
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()} == {(r.doc_id, r.taken) for r in got}
    assert mixing.draw_mix(docs).count() == sum(r.copies for r in got)


def test_mix_rounding_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(120)], "doc_id long, text string, source string")
    runs = [{r.doc_id: (r.copies, r.target / r.source_size) for r in mixing.mix(docs, seed=s).select("doc_id", "copies", "target", "source_size").collect()} for s in range(6)]
    mean = sum(c for run in runs for c, _ in run.values()) / (6 * 120)
    assert abs(mean - sum(rate for _, rate in runs[0].values()) / 120) < 0.05
    assert len({tuple(sorted((d, c) for d, (c, _) in run.items())) for run in runs}) > 1


def test_mix_edges(awkward, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(empty).count() == 0 and mixing.draw_mix(empty).columns == empty.columns


def test_shards_are_even_and_gapless(spark, awkward, empty):
    rows = [(i if i % 3 else 7, f"t{i}") for i in range(2000)]  # one key holds a third
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 2000 and set(slots) == set(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty).count() == 0
    by = {r.doc_id: r for r in sharding.assign(awkward).collect()}
    assert by[3].size == 8 and by[3].text_crc32 == 0 and by[6].size == 150_008


def test_plan_matches_row_by_row_walk():
    rng = random.Random(2)
    owners = [rng.randrange(5) for _ in range(30)] + list(range(5))
    counts = [rng.randrange(9) for _ in owners]
    room = sharding.capacities(sum(counts), 5)
    taken = [[None] * c for c in counts]
    left = list(room)
    for turn in range(len(owners)):  # each turn, row by row, in order of arcs and ranks
        for a, row in enumerate(taken):
            for k in range(len(row)):
                s = owners[(a + turn) % len(owners)]
                if row[k] is None and left[s]:
                    row[k], left[s] = s, left[s] - 1
    got = [[None] * c for c in counts]
    for a, lo, hi, s, _ in sharding.plan(counts, owners, room):
        for k in range(lo, hi):
            assert got[a][k] is None
            got[a][k] = s
    assert got == taken and left == [0] * 5


def test_most_rows_stay_when_a_shard_is_added(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "cast(id as string) text")
    a = {r.doc_id: r.shard for r in sharding.assign(docs, 10).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(docs, 11).collect()}
    assert sum(a[i] == b[i] for i in a) > 0.8 * len(a)


def test_shards_do_not_depend_on_the_layout(spark, awkward):
    docs = spark.createDataFrame([(i % 40 if i % 3 else 7, f"t{i % 900}") for i in range(3000)] + [(1, "same")] * 5000, "doc_id long, text string")
    one, two = ({tuple(r) for r in sharding.assign(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two and len(one) == 8000
    assert sorted(tuple(r)[1:] for r in sharding.assign(awkward).collect()) == sorted(tuple(r)[1:] for r in sharding.assign(awkward.repartition(5)).collect())


@pytest.fixture
def clashing(spark):
    names = ["doc_id", "text", "source", "dedup_id", "Dedup_Digest", "mix_id", "mix_size", "_copies", "_id", "_digest", "places", "pii_places"]
    return spark.createDataFrame([(1, "a b c d e", "s", *"zzzzzzzzz"), (2, "a b c d e", "s", *"yyyyyyyyy"), (3, "other words", "t", *"xxxxxxxxx")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))


def test_extra_columns_come_back_as_they_were(clashing):
    for got in (exact_dedup.drop_copies(clashing), ngram_join.one_of_each_group(clashing), mixing.draw_mix(clashing), surrogates.replace(clashing, b"k").drop("n_entities")):
        rows = got.select(clashing.columns).collect() if set(got.columns) == set(clashing.columns) else None
        assert rows and {tuple(r) for r in rows} <= {tuple(r) for r in clashing.collect()}


def test_the_index_decides(spark, monkeypatch):
    """Without its anti-join every batch would be appended, and a text would have two rows that stay."""
    docs = spark.createDataFrame([(i, f"t{i % 10}") for i in range(40)], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.dedup_table(docs, batches=3).collect() if r.kept) == list(range(30, 40))
    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", lambda self, winners: winners)
    assert sum(r.kept for r in exact_dedup.dedup_table(docs, batches=3).collect()) > 10


def test_index_is_compacted(spark):
    index = exact_dedup.DigestIndex.fresh(spark)
    for b in range(2):
        exact_dedup.dedup_batch(spark.range(100 * b, 100 * b + 100).selectExpr("id doc_id", "'t' || id text"), index, str(b)).collect()
    files = lambda i: len(spark.read.parquet(i.path).inputFiles())
    small = index.compact()
    assert sorted(r.keep_id for r in small.rows().collect()) == list(range(200)) and files(small) < files(index)


def test_mix_survives_meeting_hashes(spark):
    units = spark.createDataFrame([(1, "a", 5, 7), (2, "a", 5, 7), (3, "a", 5, 8), (4, "b", 5, 100)], "doc_id long, source string, size long, id long")
    got = mixing._told_apart(units).collect()
    assert len({r.id for r in got}) == 4 and sorted(r.doc_id for r in got) == [1, 2, 3, 4]
