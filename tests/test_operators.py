import datetime as dt
import io
import random
import zipfile

from pyspark.sql import functions as F

from evistrata.functions import html, identifiers, text
from evistrata.operators import graph, metrics, revisions, sinks
from evistrata.operators.applicability import version_key
from evistrata.operators.revisions import RevisionSpec
from evistrata.sources import documents
from evistrata.streaming import refresh


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_latest_breaks_ties_by_the_named_column(spark):
    rows = spark.createDataFrame([(1, "s", "r", 5), (2, "s", "r", 5), (3, "s", "q", 1)], "snapshot_id long, source_id string, source_record_key string, modified_at long")
    assert sorted(r.snapshot_id for r in revisions.latest_by(rows, RevisionSpec()).collect()) == [2, 3]


def test_supersession_stays_within_a_source(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, None), (2, "a", "y", 2, "x"), (3, "b", "x", 1, None), (4, "b", "z", 1, "z")], "snapshot_id long, source_id string, source_record_key string, modified_at long, sup string")
    kept = lambda **k: sorted(r.snapshot_id for r in revisions.effective(rows, RevisionSpec(supersedes="sup", **k)).collect())
    assert kept() == [2, 3] and kept(ignore_self=True) == [2, 3, 4]


def test_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("g", "g"), ("h", None)], "r string, s string")
    assert sorted(x.record for x in revisions.supersession_cycles(rows, "r", "s").collect()) == ["a", "b", "c", "g"]


def test_record_state_forgets_removed_records(spark):
    rows = spark.createDataFrame([("a", 1, "upsert"), ("a", 2, "tombstone"), ("b", 1, "retraction"), ("b", 2, "upsert"), (None, 3, "upsert")], "k string, t long, action string")
    assert [r.k for r in revisions.reduce_state(rows, "k", ["t"], "action").collect()] == ["b"]


def test_components_match_union_find(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_ranges_ask_for_all_that_they_name(spark):
    from evistrata.operators import applicability

    technologies = spark.createDataFrame([(1, "v", "p", "1.0", 0.9, False, "linux", "ent", ["a"]), (2, "v", "p", ".".join(["1"] * 15) + ".3", 0.9, False, "linux", None, None)], "technology_id long, vendor string, product string, version string, confidence double, expired boolean, platform string, edition string, identifiers array<string>")
    long_ = ".".join(["1"] * 15)
    cases = [  # range, edition, scheme, introduced, fixed, limit, last affected, identifiers, states of the two
        ("semver", None, None, None, None, "1.0", None, ("applicable", "not_applicable")), ("rpm", None, None, None, None, "1.0", None, ("applicable", "review_required")), ("deb", None, "0.9", None, None, None, None, ("review_required", "review_required")),
        ("semver", "ent", "0.1", None, None, None, None, ("applicable", "not_applicable")), ("semver", None, f"{long_}.2", f"{long_}.4", None, None, None, ("not_applicable", "applicable")), ("semver", None, "0.1", None, "1.0", None, None, ("not_applicable", "not_applicable")),
        ("semver", None, "0.1", None, None, None, ["a", "b"], ("applicable", "not_applicable")),
    ]
    rows = [(i, i, "v", "p", None, s, e, lo, fixed, limit, last, ids, True, False, False) for i, (s, e, lo, fixed, limit, last, ids, _) in enumerate(cases)]
    ranges = spark.createDataFrame(rows, "range_id long, vulnerability_id long, vendor string, product string, platform string, scheme string, edition string, introduced string, fixed string, limit string, last_affected string, identifiers array<string>, introduced_inclusive boolean, fixed_inclusive boolean, backported_fix boolean")
    got = {(r.vulnerability_id, r.technology_id): r.state for r in applicability.assess(technologies, ranges).collect()}
    assert [(got[i, 1], got[i, 2]) for i in range(len(cases))] == [c[-1] for c in cases]


def test_versions_order_numbers_after_words(spark):
    rows = spark.createDataFrame([(v,) for v in ("1.10", "1.9", "v1.9.1", "1.9rc1", "1.9.0", "2")], "v string")
    assert [r.v for r in rows.orderBy(version_key("v"), "v").collect()] == ["1.9rc1", "1.9", "1.9.0", "v1.9.1", "1.10", "2"]


def test_quality_fold_matches_a_loop(spark):
    rng = random.Random(3)
    runs = [(s, i, rng.choice([0, 10, 12, 200]), rng.choice([0.9, 0.9, 0.1]), rng.choice("aaaab")) for s in range(5) for i in range(40)]
    got = {r.s: (r.samples, r.rejected, r.volume_anomalies) for r in metrics.quality_states(spark.createDataFrame(runs, "s long, i long, records long, population double, fingerprint string"), "s", ["i"]).collect()}
    for s in range(5):
        n, level, field, known, rejected, bad = 0, None, None, set(), 0, 0
        for _, _, x, p, f in (r for r in runs if r[0] == s):
            warm = n < 3
            volume = not warm and (x > 0 if level == 0 else x < 0.2 * level or x > 5 * level)
            ok = warm or not (volume or field >= 0.8 and p < field - 0.4 or f not in known)
            bad += volume
            if warm:
                known.add(f)
            if ok:
                level = x if level is None else 0.75 * level + 0.25 * x
                field = p if field is None else 0.75 * field + 0.25 * p
                n += 1
            rejected += not ok
        assert got[s] == (n, rejected, bad)


def test_quality_state_goes_on_between_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    runs = [(s, i, [10, 12, None, 200, 0][(i * i + len(s or "")) % 5], [0.9, None, 0.1][i % 3 if i > 5 else 0], [None, "a", "b"][(i + 1) % 3]) for s in ("big", "x", None) for i in range(90 if s == "big" else 4)]
    table = spark.createDataFrame(runs, "s string, i long, records long, population double, fingerprint string")
    whole = sorted(map(tuple, metrics.quality_states(table, "s", ["i"]).collect()), key=repr)
    try:
        spark.conf.set(name, "7")
        states = metrics.quality_states(table, "s", ["i"])
        assert sorted(map(tuple, states.collect()), key=repr) == whole and {(r[0], r[1]) for r in whole} == {("big", 90), ("x", 4), (None, 4)}
        assert "collect_list" not in states._jdf.queryExecution().toString()
    finally:
        spark.conf.set(name, before)


def test_sinks(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert sorted((r.k, r.v, r.action) for r in sinks.merge_rows(make([(1, "a"), (2, "b")]), make([(2, None), (3, "c")]), ["k"]).collect()) == [(1, "a", "keep"), (2, "b", "update"), (3, "c", "insert")]
    assert sorted(r.k or 0 for r in sinks.only_new(make([(1, "a"), (None, "x")]), make([(1, "z"), (None, "y"), (None, "y"), (4, "q"), (4, "q")]), ["k"]).collect()) == [0, 0, 4]
    assert sorted((r.k, r.action) for r in sinks.synchronise(make([(1, "a"), (2, "b")]), make([(2, "b"), (3, "c")]), ["k"]).collect()) == [(1, "delete"), (2, "refresh"), (3, "insert")]
    timed = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    assert [(r.k, r.v) for r in sinks.newest(timed([(1, 5, "old")]), timed([(1, 4, "late")]), ["k"], "at").collect()] == [(1, "old")]


def test_identifiers(spark):
    assert one(spark, "732 829 320", identifiers.siren) == "732829320" and one(spark, "732829321", identifiers.siren) is None
    assert one(spark, "5493001KJTIIGC8Y1R12", identifiers.lei) == "5493001KJTIIGC8Y1R12" and one(spark, "5493001KJTIIGC8Y1R13", identifiers.lei) is None
    assert one(spark, "siren:732829320", identifiers.registration) == "siren:732829320" and one(spark, "12", identifiers.registration) is None
    assert one(spark, " Ann@Mail.Example.COM. ", identifiers.email) == "ann@mail.example.com" and one(spark, "a@b@c", identifiers.email) is None
    assert one(spark, "host.internal", identifiers.domain) is None and one(spark, "10.0.0.1", identifiers.domain) is None
    assert one(spark, "https://x", lambda c: identifiers.name_uuid(c)) == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "https://x"))
    import hashlib
    import hmac

    assert one(spark, "é", lambda c: identifiers.hmac_sha256(b"pepper", c)) == hmac.new(b"pepper", "é".encode(), hashlib.sha256).hexdigest()


def test_urls(spark):
    assert one(spark, "HTTPS://Ex.org:443/a?b=2&a=1#f", text.canonical_url) == "https://ex.org/a?a=1&b=2"
    assert one(spark, "http://ex.org", text.canonical_url) == "http://ex.org/" and one(spark, "ftp://ex.org/", text.canonical_url) is None and one(spark, "http://u@ex.org/", text.canonical_url) is None
    assert one(spark, "https://www.Ex.org./x", text.host_of) == "ex.org"


def test_documents(spark, tmp_path):
    page = '<html lang="fr"><head><title> A  b </title><meta name=robots content="noindex"><link rel=alternate type="application/rss+xml" href="/f"></head><body>x<script>y</script> z<a href="/a#t">1</a><a rel=nofollow href=b>2</a><a href="mailto:x">3</a></body></html>'
    assert html.visible(page) == {"title": "A b", "lang": "fr", "text": "A b x z 1 2 3", "noindex": True, "noarchive": False}
    assert html.page_links(page, "http://e.org/p/") == ["http://e.org/a"] and html.feed_links(page, "http://e.org/") == ["http://e.org/f"]
    assert html.site_map("<urlset><url><loc> http://a/ </loc></url><url><loc>http://a/</loc></url></urlset>") == [("page", "http://a/")]
    assert html.site_map("<!DOCTYPE x><urlset/>") == [] and html.site_map("broken") == []
    assert html.feed("<rss><channel><item><title>t</title><link>http://a</link><pubDate>d</pubDate></item></channel></rss>") == [("http://a", "t", "d")]
    assert html.contact_file("# c\nContact: mailto:a\n\nExpires: x") == [("contact", "mailto:a"), ("expires", "x")]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("rows.csv", "﻿a;b\n1;é\n2;y\n")
    (tmp_path / "x.zip").write_bytes(body.getvalue())
    assert sorted(r.row["b"] for r in documents.zipped_rows(spark, str(tmp_path)).collect()) == ["y", "é"]
    advisory = '{"id":"GHSA-1","aliases":["CVE-2","CVE-1"],"modified":"2","affected":[{"package":{"ecosystem":"npm","name":"p"},"ranges":[{"type":"SEMVER","events":[{"introduced":"1.0"},{"fixed":"1.2"}]}]}]}'
    found = documents.advisories(spark.createDataFrame([(advisory,), ("no json",)], "value string"))
    assert [r.canonical_id for r in found.collect()] == ["CVE-1"] and [(r.introduced, r.fixed) for r in documents.affected_ranges(found).collect()] == [("1.0", "1.2")]


def test_jobs(spark):
    at = F.lit(dt.datetime(2024, 1, 1, 10, 7)).cast("timestamp_ntz")
    sources = spark.createDataFrame([(1, 3600), (2, 3600)], "source_id long, interval_seconds long")
    due = refresh.due_jobs(sources, spark.createDataFrame([(2,)], "source_id long"), at).collect()
    assert [(r.source_id, r.slot) for r in due] == [(1, dt.datetime(2024, 1, 1, 10, 0))]
    jobs = spark.createDataFrame([(1, 2, 4, dt.datetime(2024, 1, 1)), (2, 4, 4, dt.datetime(2024, 1, 1))], "job_id long, attempts long, max_attempts long, scheduled_at timestamp_ntz")
    assert [(r.state, r.scheduled_at.minute) for r in refresh.after_failure(jobs, at).orderBy("job_id").collect()] == [("pending", 8), ("dead_letter", 0)]
