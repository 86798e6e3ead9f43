"""Registered queries over the column functions, filters, joins and details, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistrata.functions import identifiers, text, times
from evistrata.plans.bindings import AS_OF, sql, table, view
from evistrata.plans.evidence import as_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(statement: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(statement)
        return f

    return add


def _terms(column: str, terms) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in terms)
    return f"list_filter([{listed}], lambda t: contains(lower({column}), t))"


@registered(f"""WITH f AS (SELECT doc_id, unnest([{", ".join(f"{{'family': '{f}', 'n': len({_terms('text', t)})}}" for f, t in text.SERVICE_TERMS.items())}]) AS x FROM documents)
    SELECT doc_id, x.family AS family, x.n AS n, least(0.95::double, 0.72::double + 0.06::double * x.n) AS confidence FROM f WHERE x.n > 0""")
def service_families(spark, sf_dir):
    return text.family_rows(table(spark, sf_dir, "documents"), F.col("text")).select("doc_id", "family", "n", "confidence")


@registered(f"""SELECT doc_id, array_to_string({_terms('text', text.JOB_TERMS)}, '|') AS job_terms, regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}}|xox[baprs]-[A-Za-z0-9-]{{10,}}') AS credential,
    (SELECT array_to_string(list_distinct_ordered, '|') FROM (SELECT list_concat({", ".join(_terms('text', t) for t in text.SERVICE_TERMS.values())}, {_terms('text', text.GENERIC_TERMS)}) AS l), (SELECT list_transform(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x) AS list_distinct_ordered)) AS cyber_terms FROM documents""")
def matched_terms(spark, sf_dir):
    rows, low = text.lowered(table(spark, sf_dir, "documents"), F.col("text")), F.col("_low")
    return rows.select("doc_id", F.array_join(text.terms_in(low, text.JOB_TERMS), "|").alias("job_terms"), text.credential_marker(F.col("text")).alias("credential"), F.array_join(text.terms_in(low, text.CYBER_TERMS), "|").alias("cyber_terms"))


HOST = r"nullif(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '^www\.', ''), '')"


@registered(f"SELECT page_id, {HOST} AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"), text.origin(F.col("url")).alias("origin"))


URL = r"""(SELECT regexp_extract(u, '^(https?)://', 1) || '://' || regexp_extract(u, '^https?://([^/?#@:]+)', 1) || CASE WHEN p = '' THEN '/' ELSE p END
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') ELSE '' END
    FROM (SELECT trim(url) AS u, regexp_extract(trim(url), '^https?://[^/?#@:]+(?::[0-9]+)?([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda x: x <> '') AS q))"""


@registered(f"SELECT page_id, {URL} AS canonical FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@registered("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, regexp_replace(upper(p_type), '[^A-Z0-9]+', '', 'g') AS code,
    lower(p_brand) || ':' || lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || ':*' AS key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS simple FROM part""")
def normal_names(spark, sf_dir):
    from evistrata.operators.graph import simple_name

    return table(spark, sf_dir, "part").select("p_partkey", text.spaced_name(F.col("p_name")).alias("name"), text.postal_code(F.col("p_type")).alias("code"), text.product_key(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string")).alias("key"), simple_name("p_name").alias("simple"))


LUHN = "(SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) % 10 = 0 FROM (SELECT cast(substr(v, 9 - i, 1) AS int) AS d, i FROM range(0, 9) t(i)))"


@registered(f"""WITH c AS (SELECT c_custkey, lpad((c_custkey * 7919)::varchar, 9, '0') AS v FROM customer) SELECT c_custkey, CASE WHEN {LUHN} THEN v END AS siren, CASE WHEN {LUHN} THEN 'siren:' || v END AS registration FROM c""")
def siren_numbers(spark, sf_dir):
    v = F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", identifiers.siren(v).alias("siren"), identifiers.registration(v).alias("registration"))


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'file:md5:' || md5(c_name) WHEN c_custkey % 3 = 1 THEN 'file:sha256:' || sha256(c_name) END AS hash_key, CASE WHEN c_custkey % 3 = 1 THEN sha256(c_name) END AS fingerprint,
    CASE WHEN c_custkey % 70 BETWEEN 1 AND 60 THEN 'AS' || c_custkey % 70 END AS asn, CASE WHEN c_custkey * 50 BETWEEN 1 AND 65535 THEN c_custkey * 50 END AS port, lower(c_mktsegment) || ':' || c_name AS resource,
    sha256(c_name || chr(0) || c_mktsegment) AS idempotency_key FROM customer""")
def indicator_keys(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    raw = F.when(k % 3 == 0, F.md5(name)).when(k % 3 == 1, F.upper(F.sha2(name, 256))).otherwise("zz")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", identifiers.hash_key(raw).alias("hash_key"), identifiers.fingerprint(raw).alias("fingerprint"), identifiers.asn(F.when(k % 70 <= 60, (k % 70).cast("string")).otherwise("x")).alias("asn"), identifiers.port(k * 50).alias("port"),
        identifiers.cloud_resource(F.concat_ws(":", "c_mktsegment", "c_name")).alias("resource"), identifiers.joined_hash(name, F.col("c_mktsegment")).alias("idempotency_key"),
    )


@registered("""SELECT event_id, make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS slot, date_trunc('month', ts)::timestamp AS month, least(30.0::double * pow(2, event_id % 8), 900.0::double) AS delay,
    CASE WHEN event_type IN ('view', 'click') THEN ts + to_days(CASE event_type WHEN 'view' THEN 30 ELSE 90 END) END AS retained_until FROM events""")
def time_columns(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", times.slot(ts, 3600).alias("slot"), times.month_start(ts).alias("month"), times.retry_delay(F.col("event_id") % 8 + 1).alias("delay"), times.retained_until(ts, F.col("event_type"), {"view": 30, "click": 90}).alias("retained_until"))


@registered("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'in_debt' END, CASE WHEN c_nationkey > 20 THEN 'far' END, CASE WHEN c_custkey % 7 = 0 THEN 'paused' END], lambda x: x IS NOT NULL), ',') AS reasons, c_acctbal >= 0 AND c_nationkey <= 20 AND c_custkey % 7 <> 0 AS allowed FROM customer")
def eligibility(spark, sf_dir):
    reasons = times.block_reasons(in_debt=F.col("c_acctbal") < 0, far=F.col("c_nationkey") > 20, paused=F.col("c_custkey") % 7 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("allowed"))


@registered("SELECT event_id, CASE WHEN a <= 864000 THEN 'fresh' WHEN a <= 1728000 THEN 'aging' ELSE 'stale' END AS state FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000.0::double AS a FROM events)")
def freshness_states(spark, sf_dir):
    from evistrata.operators.fusion import age_days

    age = age_days("ts", as_of("TIMESTAMP '2024-01-31 00:00:00'")) * 86_400
    return table(spark, sf_dir, "events").select("event_id", times.freshness_state(age, 1_728_000).alias("state"))


@registered("""SELECT contract_id, buyer_id, amount, renewal_at FROM v_contract c WHERE status IN ('open', 'planned') AND country = 'NATION_1' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = contract_id AND l_returnflag = 'N')
    ORDER BY renewal_at IS NULL, renewal_at, contract_id LIMIT 50 OFFSET 10""")
def list_contracts(spark, sf_dir):
    """A page of contracts: filters, EXISTS as a semi-join, missing dates last; only the page is sorted."""
    rows = view(spark, sf_dir, "v_contract").filter(F.col("status").isin("open", "planned") & (F.col("country") == "NATION_1"))
    child = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("contract_id"))
    return rows.join(child, "contract_id", "left_semi").orderBy(F.col("renewal_at").asc_nulls_last(), "contract_id").offset(10).limit(50).select("contract_id", "buyer_id", "amount", "renewal_at")


@registered("SELECT count(*) AS total, count(DISTINCT buyer_id) AS buyers FROM v_contract WHERE buyer_name ILIKE '%customer#%7%' AND (status = 'open' OR family LIKE '1-%')")
def count_contracts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_contract").filter(F.col("buyer_name").ilike("%customer#%7%") & ((F.col("status") == "open") | F.col("family").like("1-%")))
    return rows.agg(F.count("*").alias("total"), F.count_distinct("buyer_id").alias("buyers"))


@registered("""SELECT o.c_custkey AS organization_id, o.c_name AS name, count(DISTINCT o_orderkey) AS contracts, count(l_orderkey) AS items, max(o_orderdate) AS newest, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS families
    FROM customer o LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def organization_details(spark, sf_dir):
    """One row per organization with counts and sets of its children, pre-aggregated before the join."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("contracts"), F.sum("n").alias("items"), F.max("o_orderdate").alias("newest"), F.collect_set("o_orderpriority").alias("f"))
    found = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return found.select(F.col("c_custkey").alias("organization_id"), F.col("c_name").alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("contracts", "items")], "newest", F.array_join(F.array_sort("f"), ",").alias("families"))


@registered("""SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%9%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def search_resources(spark, sf_dir):
    """Own text OR a child's: one existence join, no union."""
    return spark.sql("SELECT c_custkey, c_name FROM {c} WHERE c_name LIKE '%9%' OR EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 400000)", c=table(spark, sf_dir, "customer"), o=table(spark, sf_dir, "orders"))


@registered("""WITH h AS (SELECT page_id, 'p' || (page_id % 3) AS provider, regexp_replace(url, '[?#].*$', '') AS url, page_id % 11 AS rank FROM pages UNION ALL SELECT page_id + 1000000, 'p' || ((page_id + 1) % 3), regexp_replace(url, '[?#].*$', ''), page_id % 5 FROM pages WHERE page_id % 2 = 0)
    SELECT url, arg_min(page_id, (rank, provider, page_id)) AS representative, min(rank) AS best_rank, count(DISTINCT provider) AS providers, count(*) AS hits FROM h GROUP BY url""")
def search_results(spark, sf_dir):
    """Hits of several providers by canonical address, with a representative."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    bare = F.regexp_replace("url", "[?#].*$", "").alias("url")
    one = p.select(i, F.concat(F.lit("p"), i % 3).alias("provider"), bare, (i % 11).alias("rank"))
    two = p.filter("page_id % 2 = 0").select((i + 1_000_000).alias("page_id"), F.concat(F.lit("p"), (i + 1) % 3).alias("provider"), bare, (i % 5).alias("rank"))
    return one.union(two).groupBy("url").agg(F.min_by("page_id", F.struct("rank", "provider", "page_id")).alias("representative"), F.min("rank").alias("best_rank"), F.count_distinct("provider").alias("providers"), F.count("*").alias("hits"))


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w AS used, sum(l_quantity) OVER w <= 100 AS allowed FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def crawl_budget(spark, sf_dir):
    """A budget per target that is used up in order: a running sum and its bound."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").withColumn("used", F.sum("l_quantity").over(w)).select("l_orderkey", "l_linenumber", "l_partkey", "used", (F.col("used") <= 100).alias("allowed"))


@registered("""WITH k AS (SELECT user_id % 80 AS k, min(event_id) AS v FROM events WHERE event_type IN ('view', 'signup', 'error') GROUP BY 1), n AS (SELECT user_id % 90 AS k, max(event_id) AS v FROM events WHERE event_type NOT IN ('view', 'signup', 'error') GROUP BY 1)
    SELECT coalesce(k.k, n.k) AS k, coalesce(n.v, k.v) AS v, CASE WHEN k.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' ELSE 'update' END AS action FROM k FULL OUTER JOIN n ON k.k = n.k""")
def upsert(spark, sf_dir):
    from evistrata.operators.sinks import merge_rows

    e = table(spark, sf_dir, "events")
    stored = e.filter("event_type in ('view', 'signup', 'error')").groupBy((F.col("user_id") % 80).alias("k")).agg(F.min("event_id").alias("v"))
    new = e.filter("event_type not in ('view', 'signup', 'error')").groupBy((F.col("user_id") % 90).alias("k")).agg(F.max("event_id").alias("v"))
    return merge_rows(stored, new, ["k"])


@registered("SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0)")
def insert_new(spark, sf_dir):
    from evistrata.operators.sinks import only_new

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return only_new(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"), ["user_id", "event_type"])


@registered("SELECT DISTINCT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN sha256('pepper' || c_name) ELSE c_name END AS name, c_custkey % 9 = 0 AS erased FROM customer")
def erase(spark, sf_dir):
    from evistrata.operators.sinks import redact

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return redact(c, c.filter("c_custkey % 9 = 0").select("c_custkey"), "c_custkey", ["name"], "pepper")
