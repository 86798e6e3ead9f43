import random
from itertools import combinations

import numpy as np
import pytest

from evistrata.llm import hamming_search, ngram_join
from evistrata.llm.shared import connected_components
from evistrata.llm.shingles import shingle_sets


def test_shingles_match_brute_force():
    rng = random.Random(7)
    texts = [None, "", " \t\n", "One", "one TWO three", "ONE two\vthree four", "a b c d e É é", "x " * 5000] + [" ".join(rng.choice("abAB") for _ in range(rng.randrange(30))) for _ in range(200)]
    seen: dict = {}
    for size in (4, 5):
        for t, got in zip(texts, shingle_sets(texts, size), strict=True):
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for c in "\t\n\v\f\r":
                lower = lower.replace(c, " ")
            w = [x for x in lower.split(" ") if x]
            want = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
            assert len(got) == len(want)
            key = (size, frozenset(want))
            assert seen.setdefault(key, tuple(got.tolist())) == tuple(got.tolist())


def brute(texts, percent, size=4):
    sets = [set(s.tolist()) for s in shingle_sets(texts, size)]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: -rng.randrange(1, 12)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("short", "block"), [(32, 600_000), (3, 3000)])
def test_components_match_brute_force(spark, monkeypatch, short, block):
    """Also with very short lists and small blocks, so that clusters are cut and compared across blocks."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passage = fresh(20)
    texts = [None, "", "one", "one", "two three", "Two THREE"] + near_copies(rng, fresh(80), 70, 4) + near_copies(rng, fresh(200), 40, 7) + near_copies(rng, fresh(12), 20, 1)
    texts += [" ".join(fresh(15) + passage + fresh(15)) for _ in range(40)] + [" ".join(passage)] * 4 + [" ".join(fresh(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 85)
    kept = {r.doc_id for r in ngram_join.one_of_each_group(docs, 5, 80).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute(texts, 80, 5)) if i == c}


def test_block_links_match_brute_force():
    rng = random.Random(3)
    base = [rng.randrange(10**9) for _ in range(60)]
    sets = [np.unique([b if rng.random() > 0.08 else rng.randrange(10**9) for b in base[: rng.randrange(40, 60)]]) for _ in range(80)]
    ids = np.arange(100, 180)
    every = np.ones(80, bool)
    links = ngram_join.link_block(ids, sets, ids, every, every, 85)
    assert len(links) < 80
    up = {i: i for i in ids.tolist()}
    root = lambda i: i if up[i] == i else root(up[i])
    for a, b in links:
        x, y = set(sets[a - 100].tolist()), set(sets[b - 100].tolist())
        assert 100 * len(x & y) >= 85 * len(x | y)
        up[root(a)] = root(b)
    for i, j in combinations(range(80), 2):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        if 100 * len(x & y) >= 85 * len(x | y):
            assert root(i + 100) == root(j + 100)


def test_edges(spark, awkward, empty):
    got = ngram_join.join_components(awkward).collect()
    assert len(got) == 10 and {(r.n_shingles, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {(0, 3), (0, 4), (0, 5)}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.one_of_each_group(empty).columns == empty.columns
    kept = ngram_join.one_of_each_group(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_components_of_a_graph(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 300), (300, 400), (400, 500)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    up: dict = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}


def test_search_matches_brute_force(spark):
    rng = random.Random(9)
    hot = rng.getrandbits(64) - (1 << 63)
    rows = [(i, hot if i % 3 == 0 else (hot ^ (1 << rng.randrange(60))) if i % 7 == 0 else rng.getrandbits(64) - (1 << 63)) for i in range(400)] + [(None, 5), (1000, None), (3, hot)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming_search.search(df, df.filter("id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    codes = {i: c for i, c in rows if i is not None and c is not None}
    for q in (i for i in codes if i % 50 == 0):
        want = sorted((bin((codes[q] ^ c) & ((1 << 64) - 1)).count("1"), i) for i, c in codes.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    assert hamming_search.search(df.limit(0), df.limit(0)).count() == 0


def test_counts_of_slots_travel_packed(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for size, most in ((0, 3), (5, 200), (3000, 3), (4096, 70000), (900, 300)):
        n = rng.integers(1, most + 1, size) if size else np.array([7])
        slots = np.sort(rng.choice(ngram_join.ROW_SLOTS, len(n), replace=False))
        places, counts = ngram_join.packed_counts(slots, n)
        total = np.ones(ngram_join.ROW_SLOTS, np.int64)
        ngram_join.add_counts(total, places, counts)
        want = np.ones(ngram_join.ROW_SLOTS, np.int64)
        want[slots] += n
        assert (total == want).all() and len(counts) + len(places or b"") <= 8 * ngram_join.ROW_SLOTS

    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).union(spark.createDataFrame([], "text string").repartition(2))  # and parts without a text
    monkeypatch.setattr(ngram_join, "materialize", lambda df, label: df)
    ranks = ngram_join.shingle_ranks(docs, 2)
    held = np.concatenate([(s.view(np.uint64) >> np.uint64(48)).astype(np.int64) for s in shingle_sets(texts, 2)])
    want = np.ceil(4 * np.log2(1 + np.bincount(held, minlength=1 << 16))).astype(int)
    loud = want > want[want > 0].mean()
    assert len(ranks) == 1 << 16 and (ranks[loud] == want[loud]).all() and not ranks[~loud].any()
