"""Fetched documents as DataFrames: one row per page, link, entry or archive row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.functions import html, text


def _exploded(rows: DataFrame, schema: str, columns: list[str], each) -> DataFrame:
    """Rows that ``each(row)`` yields for every row of ``rows``, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.itertuples(index=False) for x in each(r)], columns=columns)

    return rows.mapInPandas(run, schema)


def page_texts(pages: DataFrame, known: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """``page_id, title, lang, text, noindex, noarchive`` of pages ``page_id, html``; of character references only ``known`` ones of titles and of texts are decoded, if given."""
    def each(r):
        found = html.visible(r.html, known=known)
        return [(r.page_id, *(found[k] for k in ("title", "lang", "text", "noindex", "noarchive")))]

    return _exploded(pages.select("page_id", "html"), "page_id long, title string, lang string, text string, noindex boolean, noarchive boolean", ["page_id", "title", "lang", "text", "noindex", "noarchive"], each)


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, link`` of the links to follow, in order, each once."""
    each = lambda r: [(r.page_id, i, u) for i, u in enumerate(html.page_links(r.html, r.url or ""))]
    return _exploded(pages.select("page_id", "url", "html"), "page_id long, pos int, link string", ["page_id", "pos", "link"], each)


def page_references(pages: DataFrame) -> DataFrame:
    """``page_id, kind, target`` of all elements that point elsewhere, each once."""
    each = lambda r: [(r.page_id, k, u) for k, u in dict.fromkeys(html.references(r.html, r.url or ""))]
    return _exploded(pages.select("page_id", "url", "html"), "page_id long, kind string, target string", ["page_id", "kind", "target"], each)


def site_maps(files: DataFrame) -> DataFrame:
    """``path, kind, link`` of site map files read as ``binaryFile``."""
    each = lambda r: [(r.path, k, u) for k, u in html.site_map(bytes(r.content).decode("utf-8", "replace"))]
    return _exploded(files.select("path", "content"), "path string, kind string, link string", ["path", "kind", "link"], each)


def feeds(files: DataFrame) -> DataFrame:
    """``path, link, title, published`` of feed files read as ``binaryFile``."""
    each = lambda r: [(r.path, *e) for e in html.feed(bytes(r.content).decode("utf-8", "replace"))]
    return _exploded(files.select("path", "content"), "path string, link string, title string, published string", ["path", "link", "title", "published"], each)


def zipped_rows(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """``path, row map<string,string>`` of CSV files inside archives; an archive is read in one task."""
    files = spark.read.format("binaryFile").load(path)
    each = lambda r: [(r.path, dict(x)) for x in html.zipped_csv(bytes(r.content), delimiter)]
    return _exploded(files.select("path", "content"), "path string, row map<string,string>", ["path", "row"], each)


#: Schema of vulnerability records of the common JSON format, as far as it is used.
ADVISORY = "id string, aliases array<string>, summary string, published string, modified string, withdrawn string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"


def advisories(records: DataFrame, column: str = "value") -> DataFrame:
    """Advisories from JSON lines: the smallest CVE alias is the canonical id, a withdrawal counts as the last change."""
    r = records.select(F.from_json(column, ADVISORY).alias("r")).select("r.*").filter("id is not null")
    ids = F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    cves = F.filter(ids, lambda x: x.like("CVE-%"))
    return r.select(F.coalesce(F.array_min(cves), "id").alias("canonical_id"), "id", ids.alias("identifiers"), "summary", F.coalesce("withdrawn", "modified").alias("modified"), F.col("withdrawn").isNotNull().alias("is_withdrawn"), "affected")


def affected_ranges(found: DataFrame) -> DataFrame:
    """``canonical_id, ecosystem, product, introduced, fixed, last_affected``: one row per range event pair."""
    a = found.select("canonical_id", F.explode("affected").alias("a")).select("canonical_id", "a.package.ecosystem", F.col("a.package.name").alias("product"), F.explode("a.ranges").alias("r"))
    pick = lambda c: F.array_max(F.transform("r.events", lambda e: e[c]))
    return a.select("canonical_id", "ecosystem", "product", pick("introduced").alias("introduced"), pick("fixed").alias("fixed"), pick("last_affected").alias("last_affected"))


def union_registries(parts: list[DataFrame], key: str = "source_id") -> DataFrame:
    """Registries as one; a key that occurs twice is an error in a column ``violation``, not a crash."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    twice = out.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate key").alias("violation"))
    return out.join(twice, key, "left")


def page_semantics(pages: DataFrame) -> DataFrame:
    """``page_id, title, published, updated, records, structured_text`` from meta elements and linked data."""
    names = ("title", "published", "updated", "records", "structured_text")

    def each(r):
        found = html.semantics(r.html)
        return [(r.page_id, *(found[k] for k in names))]

    return _exploded(pages.select("page_id", "html"), "page_id long, title string, published string, updated string, records int, structured_text string", ["page_id", *names], each)


def public_contents(fetched: DataFrame) -> DataFrame:
    """``path, title, text`` of bodies ``path, mime, content, quarantined, tombstoned`` by their type; what is set aside or gone is not read."""
    each = lambda r: [(r.path, *html.public_content(r.mime, bytes(r.content)))]
    return _exploded(fetched.filter("not quarantined and not tombstoned").select("path", "mime", "content"), "path string, title string, text string", ["path", "title", "text"], each)


def contact_files(files: DataFrame) -> DataFrame:
    """``path, field, values`` of security contact files read as ``binaryFile``."""
    each = lambda r: [(r.path, k, v) for k, v in html.contact_file(bytes(r.content).decode("utf-8", "replace"))]
    return _exploded(files.select("path", "content"), "path string, field string, value string", ["path", "field", "value"], each).groupBy("path", "field").agg(F.array_sort(F.collect_list("value")).alias("values"))


def job_texts(jobs: DataFrame) -> DataFrame:
    """``jobs`` with the text of its column ``description``, which holds markup."""

    @F.pandas_udf("string")
    def to_text(values: pd.Series) -> pd.Series:
        return values.map(html.job_text, na_action=None)

    return jobs.withColumn("description", to_text("description"))


#: A state that a page had when it was fetched, as the collector keeps it.
STATE = "array<struct<kind:string,source_locator:string,payload_json:string,source_url:string,http_status:int,media_type:string,extractor_id:string>>"


def structured_states(results: DataFrame) -> DataFrame:
    """One row for each captured state of ``resource_version_id, organization_id, fetched_url, states`` (JSON text)."""
    found = results.select("organization_id", "resource_version_id", F.col("fetched_url").alias("page_url"), F.inline_outer(F.from_json("states", STATE)))
    return found.filter("kind is not null").withColumn("payload_hash", F.sha2("payload_json", 256))


def response_references(responses: DataFrame) -> DataFrame:
    """References that response headers make: ``page_id, kind, target`` of link, location and content policy headers (``headers map<string,string>``)."""
    h = responses.select("page_id", F.explode("headers").alias("name", "value")).withColumn("name", F.lower("name"))
    links = h.filter("name = 'link'").select("page_id", F.lit("header_link").alias("kind"), F.explode(F.regexp_extract_all("value", F.lit("<([^>]+)>"), F.lit(1))).alias("target"))
    moved = h.filter("name in ('location', 'content-location')").select("page_id", F.col("name").alias("kind"), F.col("value").alias("target"))
    policy = h.filter("name = 'content-security-policy'").select("page_id", F.lit("policy").alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(r"(https?://[^\s;]+)"), F.lit(1))).alias("target"))
    return links.unionByName(moved).unionByName(policy).distinct()


def paged_rows(rows: DataFrame, order: str, offset: int, most: int) -> DataFrame:
    """A page of an archive's rows in their order."""
    return rows.orderBy(order).offset(offset).limit(most)


def in_scope(links: DataFrame, hosts: list[str], most: int) -> DataFrame:
    """The first ``most`` canonical links of each file (``path, pos, link``) to the given hosts, each once."""
    shown = links.withColumn("link", text.canonical_url(F.col("link"))).filter(text.host_of(F.col("link")).isin(*hosts))
    first = shown.groupBy("path", "link").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("path").orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("path", "pos", "link")
