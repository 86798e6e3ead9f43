import datetime as dt
import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from evistrata.functions import canonical


def iso(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=dt.timezone.utc).isoformat()
    return v.isoformat() if isinstance(v, dt.date) else {k: iso(x) for k, x in v.items()} if isinstance(v, dict) else [iso(x) for x in v] if isinstance(v, list) else iso(v.asDict()) if hasattr(v, "asDict") else v


def dumps(v):
    return json.dumps(iso(v), sort_keys=True, separators=(",", ":"))


def test_doubles_have_their_shortest_form(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 0.1 + 0.2, 1 / 3, 1e-4, 9.999e-5, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 2e23, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, math.inf, -math.inf, 100.0, 1e-5, 12345.678, 9007199254740993.0]
    values += [rng.random() for _ in range(300)] + [round(rng.random() * 10 ** rng.randrange(-8, 20), rng.randrange(6)) for _ in range(300)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(400)) if math.isfinite(x)]
    d = spark.createDataFrame([(v,) for v in values], "x double").select("x", canonical.shortest(F.col("x")).alias("s"))
    wrong = [(r.x, r.s) for r in d.collect() if r.s != json.dumps(r.x)]
    assert not wrong, wrong[:5]
    assert spark.range(1).select(canonical.shortest(F.lit(float("nan"))).alias("s")).first().s == "NaN"


def test_rows_of_all_types(spark):
    texts = ["", "plain", 'q"\\/', "tab\t\n\r\b\f\x01\x1f\x7f", "é漢字", "🦊a", " ", None]
    rows = [(i, t, [t, "x"], {t or "k": i, "é": None, "a": 2}, dt.datetime(2024, 1, 2, 3, 4, 5, i), dt.date(2024, 1, 2) if i else None, i % 2 == 0, (2.5, [(t,)], None), None) for i, t in enumerate(texts)]
    schema = "z long, text string, list array<string>, m map<string,long>, at timestamp_ntz, day date, flag boolean, nested struct<b:double,a:array<struct<t:string>>,n:int>, none array<int>"
    d = spark.createDataFrame(rows, schema)
    for r in d.select("*", canonical.canonical_row(d).alias("json"), canonical.digest(d).alias("sha"), canonical.canonical_row(d, ["z", "flag"]).alias("some")).collect():
        want = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("json", "sha", "some")}
        assert r.json == dumps(want) and r.sha == hashlib.sha256(dumps(want).encode()).hexdigest() and r.some == dumps({"z": r.z, "flag": r.flag})
    assert d.limit(0).select(canonical.digest(d)).count() == 0


def test_a_claim_by_its_fixed_fields(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    d = spark.createDataFrame([("s", "r", at, 0.25, True, 7, "ignored")], "source_id string, source_record_key string, modified_at timestamp_ntz, confidence double, active boolean, organization_id long, other string")
    want = dict.fromkeys(canonical.INCIDENT_CLAIM) | {"source_id": "s", "source_record_key": "r", "modified_at": "2024-01-02T03:04:05+00:00", "confidence": 0.25, "active": True, "organization_id": "7"}
    assert d.select(canonical.incident_claim_digest(d).alias("x")).first().x == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
