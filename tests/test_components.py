import random

from pyspark.sql import functions as F

from evistrata.operators import components, vulnerabilities


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def labels(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_components_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(components, "TIED", 5)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200, 260)]
    rng.shuffle(chain)
    star = [(500, i) for i in range(501, 560)]
    edges = chain + star + [(rng.randrange(900, 960), rng.randrange(900, 960)) for _ in range(45)] + [(7, 7), (7, 7), (300, 301), (301, 300)]
    d = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)
    assert labels(components.connected(d)) == plain(edges)
    assert components.connected(d.limit(0)).count() == 0


def test_nodes_of_one_part_take_no_part_in_the_rounds(spark, monkeypatch):
    kept, written = {}, components.written
    monkeypatch.setattr(components, "written", lambda d, label: kept.setdefault(label, []).append(written(d, label)) or kept[label][-1])
    edges = [(f"p{i}", f"s{i % 7}") for i in range(400)] + [(f"s{i}", f"t{i % 3}") for i in range(7)] + [("z", "z"), ("p5", "p5")]
    d = spark.createDataFrame(edges, "a string, b string").repartition(4)
    assert labels(components.connected(d)) == plain(edges)
    ends = {x for r in kept["core"][0].collect() for x in r}
    assert len(ends) <= 7 + 3 + 1 + 7 * 4  # s, t, p5 and the least nodes of four parts; all 412 nodes moved in each round before
    assert all(d.count() <= len(ends) for d in kept["stars"])


def test_batches_in_any_order_give_the_labels_of_one_run(spark, tmp_path):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    for order in (1, 2):
        parts = [edges[:20], edges[20:35], edges[35:]]
        random.Random(order).shuffle(parts)
        kept = components.store(spark, str(tmp_path / str(order)))
        stored = {}
        for i, part in enumerate(parts):
            told = {(r.component, r.merged_into) for r in components.grow(kept, f"b{i}", spark.createDataFrame(part, "a string, b string")).collect()}
            now = plain([*[(k, v) for k, v in stored.items()], *part])
            groups = {}
            for old in set(stored.values()):
                groups.setdefault(now[old], set()).add(old)
            assert told == {(old, new) for new, olds in groups.items() if len(olds) > 1 for old in olds}
            stored = now
            assert labels(kept.read("labels").select("node", "component")) == stored
            assert {(r.component, r.node) for r in kept.read("members").collect()} == {(c, n) for n, c in stored.items()}
        assert stored == plain(edges)
        assert components.grow(kept, "b0", spark.createDataFrame(parts[0], "a string, b string")).count() == 0


def test_alias_conflicts_and_sets_of_touched_groups(spark, tmp_path):
    kept = components.store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "snapshot_id long, canonical_id string, aliases array<string>")
    assert vulnerabilities.persist(kept, "1", rows((1, "ghsa-2", ["cve-2024-9"]), (2, "CVE-2024-1", None), (3, "??", []))).count() == 0
    told = vulnerabilities.persist(kept, "2", rows((4, "GHSA-2", ["CVE-2024-1", "X-1"]), (5, "Y-1", [])))
    assert {(r.component, r.merged_into) for r in told.collect()} == {("CVE-2024-9", "CVE-2024-1"), ("CVE-2024-1", "CVE-2024-1")}
    only = told.select(F.col("merged_into").alias("component")).distinct()
    assert [(r.canonical_id, r.aliases) for r in vulnerabilities.alias_sets(kept, only).collect()] == [("CVE-2024-1", ["CVE-2024-9", "GHSA-2", "X-1"])]
    assert {r.canonical_id for r in vulnerabilities.alias_sets(kept).collect()} == {"CVE-2024-1", "Y-1"}
