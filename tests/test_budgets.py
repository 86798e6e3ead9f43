"""Budgets against a plain loop over the rows of each scope."""

import random

from evistrata.operators import budgets

SCOPE = "scope_id long, hosts array<string>, paths array<string>, max_pages int, max_total_bytes long"
TARGET = "target_id long, scope_id long, host string, path string, depth int, redirects int, size long, mime string"


def loop(targets, scopes, usage):
    used, out = dict(usage), {}
    limits = {s[0]: s for s in scopes}
    for i, scope, host, path, depth, redirects, size, mime in sorted(targets):
        if scope not in limits:
            continue
        _, hosts, paths, pages, total = limits[scope]
        p, b = used.get(scope, (0, 0))
        pages, total, size = pages or 250, total or 25_000_000, size or 0
        kind = (mime or "").split(";")[0].strip().lower()
        if host not in hosts:
            got = ("host_not_allowed", None)
        elif not any(x == "/" or path == x or path.startswith(x.rstrip("/") + "/") for x in paths):
            got = ("path_not_allowed", None)
        elif not 0 <= depth <= 3:
            got = ("depth_exceeded", None)
        elif not 0 <= redirects <= 5:
            got = ("redirect_limit_exceeded", None)
        elif p >= pages:
            got = ("page_budget_exceeded", None)
        elif b >= total:
            got = ("total_byte_budget_exceeded", None)
        elif not 0 <= size <= 5_000_000:
            got = ("allowed", "resource_size_exceeded")
        elif b + size > total:
            got = ("allowed", "total_byte_budget_exceeded")
        elif kind not in ("text/html", "text/plain"):
            got = ("allowed", "mime_not_allowed")
        else:
            got = ("allowed", "allowed")
            used[scope] = (p + 1, b + size)
        out[i] = got
    return out, used


def test_decisions_equal_a_loop_also_in_parts(spark):
    rng = random.Random(4)
    scopes = [(s, ["good.org"], ["/docs", "/"] if s == 1 else ["/docs"], rng.choice([None, 5, 20]), rng.choice([None, 9_000_000])) for s in range(6)]
    targets = [
        (i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9]), rng.choice(["good.org"] * 8 + ["bad.org"]), rng.choice(["/docs", "/docs/x", "/docs/x", "/docs2"]), rng.choice([0, 1, 3, 4, -1]), rng.choice([0, 0, 0, 5, 6]),
         rng.choice([None, -1, 0, 100_000, 900_000, 4_000_000, 6_000_000]), rng.choice(["text/html", "Text/Plain; charset=x", "image/png", None]))
        for i in range(600)
    ]
    want, left = loop(targets, scopes, {2: (4, 8_000_000)})
    s, t = spark.createDataFrame(scopes, SCOPE), spark.createDataFrame(targets, TARGET)
    start = spark.createDataFrame([(2, 4, 8_000_000)], "scope_id long, pages long, bytes long")
    decided, after = budgets.crawl(t, s, start)
    assert {r.target_id: (r.target_reason, r.response_reason) for r in decided.collect()} == want
    assert {r.scope_id: (r.pages, r.bytes) for r in after.collect() if r.pages or r.bytes} == {k: v for k, v in left.items() if v != (0, 0)}
    parts, after = budgets.in_order(lambda part, usage: budgets.crawl(part, s, usage), [t.filter("target_id < 200"), t.filter("target_id between 200 and 450"), t.filter("target_id > 450")], start)
    assert {r.target_id: (r.target_reason, r.response_reason) for p in parts for r in p.collect()} == want
    assert {r.scope_id: (r.pages, r.bytes) for r in after.collect() if r.pages or r.bytes} == {k: v for k, v in left.items() if v != (0, 0)}


def test_a_refused_target_takes_nothing(spark):
    rows = [(i, 1, "h", "/", 0, 0, size, "text/html") for i, size in enumerate([4_800_000] * 5 + [5_000_000, 900_000])]
    decided, after = budgets.crawl(spark.createDataFrame(rows, TARGET), spark.createDataFrame([(1, ["h"], ["/"], None, None)], SCOPE))
    assert [r.response_reason for r in decided.orderBy("target_id").collect()] == ["allowed"] * 5 + ["total_byte_budget_exceeded", "allowed"]
    assert after.first().asDict() == {"scope_id": 1, "pages": 6, "bytes": 24_900_000}
    none, after = budgets.crawl(spark.createDataFrame([], TARGET), spark.createDataFrame([(1, ["h"], ["/"], None, None)], SCOPE))
    assert none.count() == 0 and after.first().pages == 0


def test_hits_go_to_the_one_target_that_still_takes_them(spark):
    targets = spark.createDataFrame([(1, 7, "o", ["h"], ["/a"], 0, 1, True), (2, 7, "o", ["h"], ["/a/b", "/c"], 0, 2, True), (3, 8, "o", ["h"], ["/"], 5, 5, True), (4, 9, "o", ["h"], ["/"], 0, 9, False)], "target_id long, organization_id long, origin string, hosts array<string>, paths array<string>, pages long, max_pages int, executable boolean")
    hits = [(10, 7, "o", "h", "/a"), (11, 7, "o", "h", "/a/b"), (12, 7, "o", "h", "/a"), (13, 7, "o", "h", "/c"), (14, 7, "o", "h", "/c"), (15, 7, "x", "h", "/a"), (16, 8, "o", "h", "/"), (17, 9, "o", "h", "/"), (18, None, "o", "h", "/"), (9, 7, "o", "h", "/a/b/z")]
    found = {r.candidate_id: (r.target_id, r.route) for r in budgets.route(spark.createDataFrame(hits, "candidate_id long, organization_id long, origin string, host string, path string"), targets).collect()}
    review = (None, "source_review")
    # 9 meets both; 10 uses up target 1, so 11 has one match; a refused or exhausted target is no match
    assert found == {9: (None, "ambiguous_target"), 10: (1, "public_web"), 11: (2, "public_web"), 12: review, 13: (2, "public_web"), 14: review, 15: review, 16: review, 17: review, 18: review}
