"""Small cases of what has no registered query of its own, or needs files and odd values."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evistrata.functions import html, identifiers, text
from evistrata.operators import fusion, professional, sinks
from evistrata.sources import documents, mappers
from evistrata.streaming import jobs

AT = dt.datetime(2024, 1, 10, 12, 0)


def at():
    return F.lit(AT).cast("timestamp_ntz")


def values(spark, items, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i long, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses_and_indicators(spark):
    assert values(spark, ["2001:4860:4860:0:0:0:0:8888", "fe80::1", "x", None, "ff02::1"], identifiers.ipv6) == ["2001:4860:4860::8888", None, None, None, None]
    assert values(spark, ["as64", "AS 1"], lambda v: identifiers.asset(F.lit("asn"), v)) == ["AS64", None]
    assert values(spark, ["HTTP://Bücher.example:80/a?b=2&a=ä#x", "http://[2001:DB8::1]:81", "http://u:p@e.org", "ftp://e.org", "http://e.org/?", None], text.any_url) == [
        "http://xn--bcher-kva.example/a?a=%C3%A4&b=2", "http://[2001:db8::1]:81/", None, None, "http://e.org/", None,
    ]
    assert values(spark, ["http://E.org:80/x", "https://e.org/", "http://e.org:81"], lambda v: text.same_origin(v, F.lit("http://e.org/y"))) == [True, False, False]
    assert values(spark, ["a SIEM b", "chairs", None], lambda v: text.relevant(v)) == [True, False, False] and values(spark, ["  STRASSE  a", "Straße A"], text.spaced_name) == ["strasse a"] * 2
    rows = spark.createDataFrame([(1, None), (1, "b")], "a long, b string").select(identifiers.row_digest("b", "a").alias("d")).collect()
    assert len({r.d for r in rows}) == 2


def test_sinks_that_refuse(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, c string")
    new, bad = sinks.insert_or_clash(make([(1, "a"), (2, "b")]), make([(1, "z"), (2, "b"), (3, "c"), (4, "x"), (4, "y")]), ["k"], "c")
    assert [r.k for r in new.collect()] == [3] and sorted(r.k for r in bad.collect()) == [1, 4]
    people = lambda rows: spark.createDataFrame(rows, "r long, person string")
    count = lambda rows: rows.groupBy("person").count()
    got = sinks.persist_people(people([(1, "a"), (2, "b"), (3, "c")]), people([(4, "a"), (5, "b"), (1, "a")]), people([(0, "b")]), ["r"], "person", count)
    assert [(r.person, r["count"]) for r in got.collect()] == [("a", 2)]
    written = []
    batch = {"signals": 1, "observations": 2, "changes": 3, "resources": 4}
    assert sinks.fan_out(batch, lambda n, d: written.append(n)) == ["observations", "signals", "changes", "resources"] == written
    assert sinks.fan_out(batch, lambda n, d: None, historical=True) == ["observations", "resources"]
    tables, left, audit = sinks.erase_everywhere({"t": (people([(1, "a"), (2, "b")]), ["r"])}, people([(7, "a"), (8, "b")]), "person", people([(0, "a")]), identifiers.hmac_sha256(b"k", F.col("person")), at(), 30)
    assert sorted((r.r, r.person, r.deleted) for r in tables["t"].collect() if r.person == "b") == [(2, "b", False)] and [r.r for r in left.collect()] == [8]
    assert [(r.erased_at, r.kept_until, "a" in r.subject_hash[:1] or len(r.subject_hash)) for r in audit.collect()][0][:2] == (AT, AT + dt.timedelta(days=30))


def test_suppressions_hide_the_identifier(spark):
    rows = spark.createDataFrame([("+33 1 23", "phone", "asked", 5), ("A@b.org", "email", "asked", 90)], "identifier string, channel string, reason string, retention_days int")
    got = professional.suppressions(rows, b"pepper", at(), 30).collect()
    assert {(r.kept_until - r.created_at).days for r in got} == {30, 90} and all(len(r.identifier_hash) == 64 for r in got)


JOB = "job_id long, source_id long, state string, attempts long, max_attempts long, worker_id string, lease_expires_at timestamp_ntz, pause_expires_at timestamp_ntz, error_code string, finished_at timestamp_ntz"


def test_leases_pauses_and_ends(spark):
    hour = dt.timedelta(hours=1)
    rows = spark.createDataFrame([(1, 1, "running", 1, 3, "w", AT + hour, None, None, None), (2, 1, "running", 1, 3, "v", AT + hour, None, None, None), (3, 2, "paused", 1, 3, None, None, AT - hour, None, None), (4, 2, "paused", 1, 3, None, None, AT + hour, None, None)], JOB)
    assert {r.job_id: r.lease_expires_at for r in jobs.heartbeat(rows, "w", at(), 7200).collect()} == {1: AT + 2 * hour, 2: AT + hour, 3: None, 4: None}
    assert {r.job_id: (r.state, r.error_code) for r in jobs.expire_pauses(rows, at()).collect()} == {1: ("running", None), 2: ("running", None), 3: ("failed", "human_checkpoint_expired"), 4: ("paused", None)}
    done = jobs.complete(rows, rows.filter("job_id in (1, 3)"), at()).collect()
    assert {r.job_id: (r.state, r.finished_at) for r in done if r.job_id in (1, 3)} == {1: ("completed", AT), 3: ("paused", None)}
    circuits = spark.createDataFrame([(1, 0, None), (2, 3, AT + hour), (3, 3, AT - hour)], "source_id long, failures long, open_until timestamp_ntz")
    assert {r.source_id: (r.allowed, r.circuit) for r in jobs.circuit_allows(circuits, at()).collect()} == {1: (True, "closed"), 2: (False, "open"), 3: (True, "half_open")}
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "part_id long, v string")
    assert [r.v for r in jobs.partial_progress(parts, parts.filter("part_id = 2")).collect()] == ["a"]
    sources = spark.createDataFrame([(1,), (2,)], "source_id long")
    first = jobs.priority_refresh(sources, spark.createDataFrame([], "job_key string"), at())
    assert first.count() == 2 and jobs.priority_refresh(sources, first.limit(1), at() + F.make_dt_interval(secs=F.lit(30))).count() == 1


def test_options_of_sources(spark):
    sources = spark.createDataFrame([(1, ["p"], ["c"], True, False, "m"), (2, ["p"], ["c"], True, True, "m"), (3, ["q"], ["c"], True, False, "m")], "source_id long, purposes array<string>, categories array<string>, executable boolean, needs_approval boolean, mode string")
    pair = lambda rows, c, kind="double": spark.createDataFrame(rows, f"source_id long, {c} {kind}")
    got = fusion.source_options(sources, "p", "c", pair([(1, "stale"), (2, "fresh")], "freshness_state", "string"), pair([(2, 0.5), (2, 1.0)], "value"), pair([(2, 3.0)], "cost"), pair([], "risk"), pair([(2, "x")], "by", "string"))
    assert sorted((r.source_id, r.value, r.freshness, r.cost, r.risk, r.viable) for r in got.collect()) == [(1, 0.0, 0.0, 0.0, 0.0, False), (2, 0.75, 1.0, 3.0, 0.0, True)]
    assert [r.source_id for r in fusion.rank_sources(got).collect()] == [2]


def test_notices_leads_and_catalogues(spark, tmp_path):
    notice = lambda **k: json.dumps({"publication_number": "1", "title": "SIEM", "notice_type": "Contract", "published": "2024-01-01T00:00:00", "deadline": "2024-02-01T00:00:00"} | k)
    rows = spark.createDataFrame([(notice(),), (notice(publication_number="2", deadline="2024-01-02T00:00:00"),), (notice(publication_number="3", title="chairs"),), (notice(publication_number="4", notice_type="AWARD"),), ("broken",)], "value string")
    publications, signals = mappers.notice_rows(rows, at())
    assert sorted(r.source_record_key for r in publications.collect()) == ["ted:1", "ted:2", "ted:4"] and signals.count() == 1
    lead = "organization_id long, source_id string, source_record_key string, original_url string, capture_at timestamp_ntz, mime string, status_code int, observed_at timestamp_ntz, crawl_id string"
    found = mappers.crawl_leads(spark.createDataFrame([(1, "s", "k", "http://e.org", AT, "text/html", 200, AT, "CC-1")], lead)).first()
    assert found.source_locator == "common-crawl:CC-1:2024-01-10T12:00:00" and found.retrieval_state == "quarantined" and found.byte_size > 0
    hits = mappers.ranked_hits(spark.createDataFrame([("p", 1, "http://E.org"), ("p", 2, "http://e.org/"), ("p", 3, "x")], "plan string, at long, url string"), "plan", "at", "url").collect()
    assert [(r.link, r.rank, r.hits) for r in hits] == [("http://e.org/", 1, 2)]
    tree = {"name": "Tools", "children": [{"name": "A", "url": "http://a"}, {"name": "Deep", "children": [{"title": "a", "link": "http://a"}, {"name": "B", "url": "no address"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    got = mappers.tool_catalogue(spark.read.format("binaryFile").load(str(tmp_path / "t.json"))).collect()
    assert [(r.name, r.url, r.categories) for r in got] == [("a", "http://a", ["Tools", "Deep"])]
    (tmp_path / "f.csv").write_text("username,name,url_main,url_user,exists,http_status,response_time_s\nu,Site,m,http://s/u,Claimed,200,1\nu,SITE,m,http://s/u,Claimed,200,1\nu,Other,m,http://o/u,Claimed,200,1\nu,Site,m,http://s/v,Available,404,1\n")
    inside, outside = mappers.account_findings(spark, str(tmp_path / "f.csv"), ["site"])
    assert [r.url_user for r in inside.collect()] == ["http://s/u"] and [r.name for r in outside.collect()] == ["Other"]
    (tmp_path / "g.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        mappers.account_findings(spark, str(tmp_path / "g.csv"), [])


def test_contents_by_type(spark):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:t>Hello</w:t><w:t>there</w:t></w:document>')
    page = '<html><head><title>T</title><meta property="og:title" content="Best"><meta property="article:published_time" content="2024-01-01"><script type="application/ld+json">{"name":"n  1","dateModified":"2024-02-02","token":"secret","list":["n 1","x"]}</script><script type="application/ld+json">broken</script></head><body>b</body></html>'
    rows = [("p", "text/html; charset=x", page.encode(), False, False), ("t", "text/plain", b" a \n b", False, False), ("b", "text/plain", b"\0\1", False, False), ("d", html.OFFICE[0], body.getvalue(), False, False), ("q", "text/plain", b"no", True, False), ("g", "text/plain", b"no", False, True), ("o", "image/png", b"x", False, False), ("z", html.OFFICE[0], b"no zip", False, False)]
    got = documents.public_contents(spark.createDataFrame(rows, "path string, mime string, content binary, quarantined boolean, tombstoned boolean"))
    assert {r.path: (r.title, r.text) for r in got.collect()} == {"p": ("Best", "T b"), "t": (None, "a b"), "b": (None, None), "d": (None, "Hello there"), "o": (None, None), "z": (None, None)}
    said = documents.page_semantics(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(said[0])[1:] == ("Best", "2024-01-01", "2024-02-02", 1, "n 1 2024-02-02 x") and tuple(said[1])[1:] == (None, None, None, 0, "")
    jobs_ = documents.job_texts(spark.createDataFrame([("<p>a&amp;b</p><style>x</style><p>c",), (None,)], "description string"))
    assert [r.description for r in jobs_.collect()] == ["a&b c", ""]


def test_files_states_and_headers(spark, tmp_path):
    (tmp_path / "security.txt").write_text("# c\nContact: mailto:b\ncontact: mailto:a\nExpires: x\n")
    found = documents.contact_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {r.field: r["values"] for r in found.collect()} == {"contact": ["mailto:a", "mailto:b"], "expires": ["x"]}
    state = json.dumps([{"kind": "state", "source_locator": "l", "payload_json": "{}", "http_status": 200}])
    rows = documents.structured_states(spark.createDataFrame([(1, 2, "u", state), (1, 3, "u", "[]"), (1, 4, "u", None)], "organization_id long, resource_version_id long, fetched_url string, states string")).collect()
    assert [(r.resource_version_id, r.kind, r.http_status) for r in rows] == [(2, "state", 200)]
    heads = spark.createDataFrame([(1, {"Link": "<http://a>; rel=x, <http://b>", "Location": "/n", "Content-Security-Policy": "img-src https://c 'self'; x", "Other": "http://d"})], "page_id long, headers map<string,string>")
    assert sorted((r.kind, r.target) for r in documents.response_references(heads).collect()) == [("header_link", "http://a"), ("header_link", "http://b"), ("location", "/n"), ("policy", "https://c")]
    links = spark.createDataFrame([("f", 0, "http://E.org"), ("f", 1, "http://e.org/"), ("f", 2, "http://x.org"), ("f", 3, "http://e.org/b"), ("f", 4, "http://e.org/c")], "path string, pos int, link string")
    assert [(r.pos, r.link) for r in documents.in_scope(links, ["e.org"], 2).orderBy("pos").collect()] == [(0, "http://e.org/"), (3, "http://e.org/b")]
