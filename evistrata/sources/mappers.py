"""Records of catalogues, tenders, jobs, archives and searches, brought to the shapes of this engine by expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.functions import text
from evistrata.functions.identifiers import name_uuid, row_digest
from evistrata.operators.vulnerabilities import vulnerability_id

# Trust in the catalogues (less is more), states by catalogue, days that a job signal lives.
PRECEDENCE = {"cve_org": 10, "nvd": 30, "epss": 40, "cve_org_mirror": 70}
NVD_STATES = {"rejected": "rejected", "modified": "updated"}
JOB_TTL_DAYS = 30

_TEXTS = "array<struct<lang:string,value:string>>"
_REFERENCES = "array<struct<url:string,tags:array<string>>>"
_METRIC = "array<struct<cvssData:struct<version:string,baseScore:double,vectorString:string>>>"
#: Schemas of the records as far as they are used.
NVD = f"cve struct<id:string,published:string,lastModified:string,vulnStatus:string,descriptions:{_TEXTS},weaknesses:array<struct<description:{_TEXTS}>>,metrics:map<string,{_METRIC}>,references:{_REFERENCES}>"
CVE = (
    "cveMetadata struct<cveId:string,state:string,datePublished:string,dateUpdated:string>, containers struct<cna:struct<title:string,descriptions:" + _TEXTS + ",problemTypes:array<struct<descriptions:array<struct<cweId:string>>>>,"
    "affected:array<struct<vendor:string,product:string,versions:array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>>>,metrics:array<map<string,struct<version:string,baseScore:double,vectorString:string>>>,references:" + _REFERENCES + ">>"
)
CONTRACT = "id string, objet string, nature string, procedure string, codeCPV string, dureeMois int, dateNotification string, datePublicationDonnees string, montant double, idModification string, acheteur struct<id:string,nom:string>, titulaires array<struct<id:string,denominationSociale:string>>"
NOTICE = "publication_number string, title string, description string, buyer_name string, buyer_country string, notice_type string, published string, deadline string, winners array<string>"

_RANGE = "array<struct<ecosystem:string,product:string,introduced:string,fixed:string,last_affected:string,precision:string>>"
_SCORE = "array<struct<system:string,value:double,vector:string,percentile:double,assessed_at:timestamp_ntz>>"
_EXPLOITATION = "array<struct<kind:string,active:boolean,first_seen_at:timestamp_ntz,last_seen_at:timestamp_ntz,due_date:timestamp_ntz,confidence:double>>"


def _time(value: Column | str) -> Column:
    return F.try_to_timestamp(F.col(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def _parsed(records: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of JSON texts. A generator, over which no filter is moved, so that each text is parsed once."""
    return records.select(F.inline(F.array(F.from_json(column, schema))))


def _with_terms(rows: DataFrame, said: Column, terms) -> DataFrame:
    """Rows in whose text ``said`` a term occurs, with ``matched_terms``; the text is lowered once."""
    return text.lowered(rows, said).withColumn("matched_terms", text.terms_in(F.col("_low"), terms)).filter(F.size("matched_terms") > 0)


def _english(texts: str) -> Column:
    """The first English text, else the first of all."""
    first = lambda a: F.get(a, F.lit(0))["value"]
    return F.coalesce(first(F.filter(texts, lambda t: F.lower(t["lang"]).startswith("en"))), first(F.col(texts)))


def _cvss(version: Column) -> Column:
    return F.concat(F.lit("cvss_v"), F.split_part(F.coalesce(version, F.lit("3")), F.lit("."), F.lit(1)))


def _snapshot(rows: DataFrame, source: str, **values: Column) -> DataFrame:
    """The columns of a vulnerability snapshot; what a catalogue does not tell is null or empty."""
    empty = {"aliases": "array<string>", "cwes": "array<string>", "scores": _SCORE, "ranges": _RANGE, "exploitation": _EXPLOITATION}
    base = {n: F.from_json(F.lit("[]"), t) for n, t in empty.items()} | {n: F.lit(None).cast("string") for n in ("title", "description", "superseded_by")}
    base |= {"source": F.lit(source), "source_precedence": F.lit(PRECEDENCE[source]), "published_at": F.lit(None).cast("timestamp_ntz")} | values
    names = ("source", "source_record_key", "source_precedence", "canonical_id", "title", "description", "status", "published_at", "modified_at", "superseded_by", *empty)
    out = rows.select(*[base[n].alias(n) for n in names])
    return out.withColumn("snapshot_id", F.xxhash64("source", "source_record_key", "modified_at"))


def nvd_snapshots(records: DataFrame, column: str = "value") -> DataFrame:
    """Snapshots from catalogue items as JSON lines; a reference tagged as exploit is a proof of concept, confidence 0.6."""
    r = _parsed(records, column, NVD).select("cve.*").filter("id is not null")
    weak = F.filter(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: F.upper(d["value"])))), lambda v: v.startswith("CWE-"))
    metrics = F.flatten(F.map_values("metrics"))
    at = _time("lastModified")
    none = F.lit(None)
    scores = F.transform(metrics, lambda m: F.struct(_cvss(m["cvssData"]["version"]).alias("system"), m["cvssData"]["baseScore"].alias("value"), m["cvssData"]["vectorString"].alias("vector"), none.cast("double").alias("percentile"), none.cast("timestamp_ntz").alias("assessed_at")))
    exploit = F.exists("references", lambda x: F.exists(x["tags"], lambda t: F.contains(F.lower(t), F.lit("exploit"))))
    proof = F.array(F.struct(F.lit("proof_of_concept").alias("kind"), F.lit(True).alias("active"), at.alias("first_seen_at"), at.alias("last_seen_at"), none.cast("timestamp_ntz").alias("due_date"), F.lit(0.6).alias("confidence")))
    state = F.coalesce(F.create_map(*[F.lit(x) for kv in NVD_STATES.items() for x in kv])[F.lower("vulnStatus")], F.lit("published"))
    return _snapshot(r, "nvd", source_record_key=F.col("id"), canonical_id=vulnerability_id(F.col("id")), description=_english("descriptions"), status=state, published_at=_time("published"), modified_at=at,
                     cwes=F.array_sort(F.array_distinct(weak)), scores=F.coalesce(scores, F.from_json(F.lit("[]"), _SCORE)), exploitation=F.when(exploit, proof).otherwise(F.from_json(F.lit("[]"), _EXPLOITATION)))


def cve_snapshots(records: DataFrame, column: str = "value", source: str = "cve_org") -> DataFrame:
    """Snapshots from CVE records as JSON lines; only versions stated as affected give ranges."""
    r = _parsed(records, column, CVE).select("cveMetadata.*", "containers.cna.*").filter("cveId is not null")
    cwes = F.array_compact(F.flatten(F.transform("problemTypes", lambda p: F.transform(p["descriptions"], lambda d: F.upper(d["cweId"])))))
    found = F.flatten(F.transform("affected", lambda a: F.transform(F.filter(a["versions"], lambda v: v["status"] == "affected"), lambda v: F.struct(
        F.coalesce(a["vendor"], F.lit("unknown")).alias("ecosystem"), a["product"].alias("product"), v["version"].alias("introduced"), v["lessThan"].alias("fixed"), v["lessThanOrEqual"].alias("last_affected"),
        F.when(v["lessThan"].isNotNull() | v["lessThanOrEqual"].isNotNull(), "range").otherwise("exact").alias("precision")))))
    none = F.lit(None)
    scores = F.flatten(F.transform("metrics", lambda m: F.transform(F.filter(F.map_entries(m), lambda e: e["key"].startswith("cvss")), lambda e: F.struct(
        _cvss(e["value"]["version"]).alias("system"), e["value"]["baseScore"].alias("value"), e["value"]["vectorString"].alias("vector"), none.cast("double").alias("percentile"), none.cast("timestamp_ntz").alias("assessed_at")))))
    empty = lambda t: F.from_json(F.lit("[]"), t)
    return _snapshot(r, source, source_record_key=F.col("cveId"), canonical_id=vulnerability_id(F.col("cveId")), title=F.col("title"), description=_english("descriptions"), status=F.when(F.lower("state") == "rejected", "rejected").otherwise("published"),
                     published_at=_time("datePublished"), modified_at=_time("dateUpdated"), cwes=F.array_sort(F.array_distinct(F.coalesce(cwes, empty("array<string>")))), scores=F.coalesce(scores, empty(_SCORE)), ranges=F.coalesce(found, empty(_RANGE)))


def epss_snapshots(rows: DataFrame) -> DataFrame:
    """Score snapshots, one for each identifier and day, from rows ``cve, epss, percentile, score_date date``."""
    at = F.col("score_date").cast("timestamp_ntz")
    score = F.array(F.struct(F.lit("epss").alias("system"), F.col("epss").cast("double").alias("value"), F.lit(None).cast("string").alias("vector"), F.col("percentile").cast("double").alias("percentile"), at.alias("assessed_at")))
    return _snapshot(rows, "epss", source_record_key=F.concat_ws(":", "cve", F.col("score_date").cast("string")), canonical_id=vulnerability_id(F.col("cve")), status=F.lit("updated"), modified_at=at, scores=score)


def contract_rows(records: DataFrame, column: str = "value") -> DataFrame:
    """Public contracts from JSON lines: those in which a service or generic term occurs; their end from notification and months."""
    r = _parsed(records, column, CONTRACT).filter("id is not null")
    said = F.concat_ws(" ", "objet", "nature", "procedure", "codeCPV")
    signed = F.to_date(_time("dateNotification"))
    ends = F.add_months(signed, F.col("dureeMois"))
    changed = F.coalesce(F.col("idModification") != "", F.lit(False))
    families = F.transform(text.service_families(F.col("_low")), lambda x: x["family"])
    return _with_terms(r, said, text.CYBER_TERMS).select(
        F.concat(F.lit("decp:contract:"), "id").alias("contract_key"), F.concat(F.lit("decp:procedure:"), "id").alias("procedure_key"), F.concat_ws(":", "id", F.nullif("idModification", F.lit(""))).alias("source_record_key"),
        F.when(changed, "amendment").otherwise("award").alias("kind"), F.when(changed, "active").otherwise("awarded").alias("status"), F.col("objet").alias("title"), F.col("acheteur.id").alias("buyer_id"), F.col("acheteur.nom").alias("buyer_name"),
        F.transform("titulaires", lambda t: t["denominationSociale"]).alias("providers"), F.col("montant").alias("amount"), _time("datePublicationDonnees").alias("published_at"), signed.alias("signed_on"), ends.alias("ends_on"),
        F.when(ends.isNotNull(), "derived").otherwise("unknown").alias("end_basis"), "matched_terms", families.alias("families"), row_digest(*r.columns).alias("payload_hash"), F.lit(0.94).alias("confidence"),
    )


def notice_rows(records: DataFrame, now: Column, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Tender notices from JSON lines as publications, and as signals those that can still be answered.

    A notice without a service or generic term is dropped; a signal needs a deadline ahead of ``now``.
    """
    r = _parsed(records, column, NOTICE).filter("publication_number is not null")
    said = F.concat_ws(" ", "title", "description")
    kept = _with_terms(r, said, text.CYBER_TERMS)
    publications = kept.select(F.concat(F.lit("ted:"), "publication_number").alias("source_record_key"), "title", "buyer_name", "buyer_country", F.lower("notice_type").alias("kind"), _time("published").alias("published_at"), "winners", "matched_terms")
    open_ = kept.filter((F.lower("notice_type") != "award") & (_time("deadline") > now))
    signals = open_.select(name_uuid(F.concat(F.lit("ted:signal:"), "publication_number")).alias("signal_id"), F.lit("public_tender").alias("signal_type"), "title", F.col("description").alias("summary"), "matched_terms", _time("published").alias("effective_at"), _time("deadline").alias("expires_at"))
    return publications, signals


def job_signals(jobs: DataFrame, collected_at: Column) -> DataFrame:
    """Signals from job postings in which a term occurs; they live thirty days.

    ``jobs`` has ``source_id, source_record_key, organization_id, title, description, department, location, employment_type, confidence``.
    """
    said = F.concat_ws(" ", "title", "description", "department")
    found = _with_terms(jobs, said, text.JOB_TERMS)
    key = F.concat_ws(":", "source_id", F.lit("signal"), "source_record_key")
    return found.select(name_uuid(key).alias("signal_id"), "source_id", "organization_id", F.lit("job_posting").alias("signal_type"), "title", "confidence", "matched_terms", collected_at.alias("collected_at"), (collected_at + F.make_dt_interval(F.lit(JOB_TTL_DAYS))).alias("expires_at"))


def job_key() -> Column:
    """What postings of one job have in common whatever the provider."""
    return F.sha2(F.concat_ws("\0", *[text.spaced_name(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("organization_id", "title", "location", "department", "employment_type")]), 256)


def same_jobs(jobs: DataFrame) -> DataFrame:
    """Postings of one job at several providers, as a group with its members' numbers and not as pairs: ``job_key, providers, postings, first_posting``."""
    found = jobs.withColumn("job_key", job_key()).groupBy("job_key").agg(F.count_distinct("source_id").alias("providers"), F.count("*").alias("postings"), F.min(F.concat_ws(":", "source_id", "source_record_key")).alias("first_posting"))
    return found.filter("providers > 1")


def _lead(leads: DataFrame, url: str, title: Column, locator: Column, mime: str, excerpt: Column, kind: str, method: str) -> DataFrame:
    """A resource in quarantine with one version made of the lead's own description."""
    material = F.to_json(F.struct(*[F.col(c) for c in sorted(leads.columns)]))
    return leads.select(
        "organization_id", "source_id", "source_record_key", F.col(url).alias("canonical_url"), F.lit(kind).alias("kind"), F.lit(method).alias("discovery_method"), F.col("observed_at").alias("first_discovered_at"), F.col("observed_at").alias("last_seen_at"),
        F.lit("unknown").alias("access_state"), F.lit("quarantined").alias("retrieval_state"), title.alias("title"), F.sha2(material, 256).alias("content_hash"), F.lit(mime).alias("mime_type"), F.octet_length(material).alias("byte_size"), locator.alias("source_locator"), excerpt.alias("excerpt"),
    )


def archive_leads(leads: DataFrame) -> DataFrame:
    """Resources from rows of an archive's index: ``organization_id, source_id, source_record_key, original_url, capture_at, mime, status_code, observed_at``."""
    at = F.date_format("capture_at", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.concat(F.lit("Historical archive index metadata: "), "mime", F.lit(", HTTP "), F.col("status_code").cast("string"), F.lit("."))
    return _lead(leads, "original_url", F.concat(F.lit("Archived snapshot "), at), F.concat(F.lit("archive-capture:"), at), "application/x-archive-metadata", said, "archive_snapshot", "archive_index")


def crawl_leads(leads: DataFrame) -> DataFrame:
    """Resources from rows of a crawl's index; as ``archive_leads`` with ``crawl_id``."""
    at = F.date_format("capture_at", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.concat(F.lit("Common Crawl index metadata from "), "crawl_id", F.lit(": "), "mime", F.lit(", HTTP "), F.col("status_code").cast("string"), F.lit("; WARC body not retrieved."))
    return _lead(leads, "original_url", F.concat(F.lit("Common Crawl index capture "), at), F.concat_ws(":", F.lit("common-crawl"), "crawl_id", at), "application/x-common-crawl-metadata", said, "archive_snapshot", "archive_index")


def search_leads(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resources from search hits, and the candidate claims that a hit proposes, with a confidence of at most 0.5."""
    found = _lead(leads, "target_url", F.col("title"), F.concat(F.lit("search-rank:"), F.col("rank").cast("string")), "application/x-search-result", F.col("snippet"), "search_result", "search_api")
    claims = leads.filter("claim is not null").select("source_id", "source_record_key", "organization_id", "claim", F.least(F.col("confidence"), F.lit(0.5)).alias("confidence"))
    return found, claims


def ranked_hits(rows: DataFrame, plan: str, position: str, url: str) -> DataFrame:
    """Rows of a crawl index as search hits of a plan: the position is the rank, one hit for each address."""
    w = Window.partitionBy(plan).orderBy(position)
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("link", text.canonical_url(F.col(url)))
    return ranked.filter("link is not null").groupBy(plan, "link").agg(F.min("rank").alias("rank"), F.count("*").alias("hits"))


def tool_catalogue(files: DataFrame) -> DataFrame:
    """``name, url, categories`` of the entries of JSON trees ``path, content``; of equal names and addresses the last counts."""

    def walk(node, above: tuple[str, ...]) -> Iterator[tuple[str, str, list[str]]]:
        if isinstance(node, list):
            for child in node:
                yield from walk(child, above)
        elif isinstance(node, dict):
            said = [next((v.strip() for k in keys if isinstance(v := node.get(k), str) and v.strip()), None) for keys in (("name", "title", "label"), ("url", "link", "href"))]
            name, url = said[0], said[1] if said[1] and said[1].startswith(("http://", "https://")) else None
            if name and url:
                yield name, url, list(above)
            inner = above if url or not name else (*above, name)
            for child in node.values():
                if isinstance(child, (dict, list)):
                    yield from walk(child, inner)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, i, *r) for p, c in zip(b["path"], b["content"], strict=True) for i, r in enumerate(walk(json.loads(bytes(c)), ()))], columns=["path", "i", "name", "url", "categories"])

    found = files.select("path", "content").mapInPandas(run, "path string, i int, name string, url string, categories array<string>")
    return found.groupBy(F.lower("name").alias("_n"), "url").agg(F.max_by(F.struct("name", "categories"), F.struct("path", "i")).alias("r")).select("r.name", "url", "r.categories")


FINDINGS = ("username", "name", "url_main", "url_user", "exists", "http_status", "response_time_s")


def account_findings(spark: SparkSession, path: str, sites: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claimed accounts of CSV files with exactly the known columns, distinct by site and address; and rows of sites out of scope, which are errors."""
    rows = spark.read.option("header", True).csv(path)
    if set(rows.columns) != set(FINDINGS):
        raise ValueError(f"columns {sorted(rows.columns)} are not those expected")
    claimed = rows.filter("exists = 'Claimed'").withColumn("_site", F.lower("name"))
    inside = F.col("_site").isin(*[s.lower() for s in sites])
    return claimed.filter(inside).dropDuplicates(["_site", "url_user"]).select("username", "name", "url_user"), claimed.filter(~inside).select("username", "name", "url_user")
