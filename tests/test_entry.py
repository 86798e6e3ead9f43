from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from evistrata.plans.bindings import AS_OF, for_spark, view

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for p in entry.PARTS for n in p.QUERIES]


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark):
    """All queries, several at a time: most of a small query's time is planning."""

    def run(name):
        df = entry.queries()[name](spark, SF)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in OWN}


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(results, duck, name):
    columns, rows = results[name].result()
    cols = sorted(columns)
    if name not in entry.oracle_sql():
        assert rows
        return
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_dialect():
    assert for_spark("a // 6") == "a div 6" and "TIMESTAMP_NTZ" in for_spark(AS_OF) and for_spark("to_days(cast(x % 3 AS int))") == "make_dt_interval(cast(x % 3 AS int))"


def test_views_and_sinks_read_whole_tables(spark):
    assert view(spark, SF, "v_range").count() == spark.read.parquet(f"{SF}/part.parquet").count()
    pairs = [(r.user_id, r.event_type, r.event_id % 2) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    new = {(r.user_id, r.event_type) for r in entry.queries()["insert_new"](spark, SF).collect()}
    assert new == {p[:2] for p in pairs} - {p[:2] for p in pairs if p[2] == 0}
