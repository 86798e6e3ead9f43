"""Column functions on text: names, terms, URLs, hosts. Invalid values give null, never an error."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Search terms of each service family, generic terms, terms of job postings.
SERVICE_TERMS = {
    "strategy_vciso": ("vciso", "virtual ciso", "rssi externalisé", "rssi externalise", "cyber strategy", "stratégie cybersécurité", "strategie cybersecurite"),
    "audit_risk_assessment": ("audit", "security audit", "audit de sécurité", "audit de securite", "risk assessment", "analyse de risques", "ebios"),
    "grc_compliance": ("grc", "governance risk compliance", "iso 27001", "nis2", "dora", "conformité", "conformite", "homologation"),
    "penetration_testing": ("penetration test", "penetration testing", "pentest", "test d'intrusion", "tests d'intrusion"),
    "red_purple_teaming": ("red team", "purple team", "adversary emulation", "simulation d'attaque"),
    "vulnerability_attack_surface": ("vulnerability management", "gestion des vulnérabilités", "gestion des vulnerabilites", "attack surface", "surface d'attaque", "asm"),
    "soc_siem_mdr_xdr_soar": ("siem", "soc", "security operations center", "centre opérationnel de sécurité", "centre operationnel de securite", "mdr", "xdr", "soar", "security monitoring", "supervision de sécurité", "supervision de securite"),
    "incident_response_dfir": ("incident response", "réponse à incident", "reponse a incident", "dfir", "forensic", "investigation numérique", "investigation numerique"),
    "resilience_crisis_readiness": ("cyber resilience", "cyber résilience", "crisis management", "gestion de crise", "business continuity", "continuité d'activité", "continuite d'activite", "disaster recovery", "reprise d'activité", "reprise d'activite"),
    "iam_iga_pam_zero_trust": ("identity and access management", "iam", "iga", "pam", "privileged access", "zero trust", "gestion des identités", "gestion des identites"),
    "cloud_container_security": ("cloud security", "sécurité cloud", "securite cloud", "container security", "kubernetes security", "cspm", "cnapp"),
    "appsec_devsecops": ("application security", "appsec", "devsecops", "secure code review", "sécurité applicative", "securite applicative", "sast", "dast"),
    "network_sase_security": ("network security", "sécurité réseau", "securite reseau", "sase", "sd-wan security", "firewall", "pare-feu", "zero trust network access", "ztna"),
    "data_protection": ("data protection", "protection des données", "protection des donnees", "data loss prevention", "dlp", "encryption", "chiffrement"),
    "third_party_supply_chain": ("third-party risk", "third party risk", "supplier risk", "supply chain security", "risque fournisseur", "risques fournisseurs", "chaîne d'approvisionnement", "chaine d'approvisionnement"),
    "ot_ics_iot_security": ("ot security", "ics security", "industrial control system", "sécurité industrielle", "securite industrielle", "iot security", "iiot"),
    "awareness_training": ("security awareness", "cyber awareness", "sensibilisation", "formation cybersécurité", "formation cybersecurite", "phishing simulation"),
    "product_integration_migration": ("security integration", "intégration de sécurité", "integration de securite", "migration siem", "migration sécurité", "migration securite", "déploiement de solution", "deploiement de solution"),
    "cyber_insurance_readiness": ("cyber insurance", "assurance cyber", "cyber-insurance readiness", "questionnaire assurance"),
}
GENERIC_TERMS = ("cybersecurity", "cyber security", "cybersécurité", "cybersecurite", "sécurité des systèmes d'information", "securite des systemes d'information")
JOB_TERMS = (
    "soc analyst", "soc manager", "soc engineer", "siem engineer", "security operations", "security operations center", "detection engineer", "detection engineering", "threat detection", "incident response", "security monitoring",
    "log management", "managed detection and response", "microsoft sentinel", "azure sentinel", "splunk enterprise security", "splunk es", "sekoia", "qradar", "xdr", "mdr",
)


def matched_terms(text: Column, terms) -> Column:
    """The terms that the lower-cased text contains anywhere, in the given order."""
    return terms_in(F.lower(text), terms)  # plain expressions, so that it is lowered once for all terms in generated code


def terms_in(low: Column, terms) -> Column:
    """The terms that a text in lower case contains anywhere, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))


def service_families(text: Column) -> Column:
    """Array of (family, number of matched terms, confidence) for families with a match."""
    low = F.lower(text)
    count = lambda terms: reduce(lambda a, b: a + b, [F.coalesce(F.contains(low, F.lit(t)).cast("int"), F.lit(0)) for t in terms])
    found = [F.struct(F.lit(f).alias("family"), count(t).alias("n")) for f, t in SERVICE_TERMS.items()]
    some = F.filter(F.array(*found), lambda x: x["n"] > 0)
    return F.transform(some, lambda x: F.struct(x["family"].alias("family"), x["n"].alias("n"), F.least(F.lit(0.95), 0.72 + 0.06 * x["n"]).alias("confidence")))


def lowered(rows: DataFrame, said: Column, name: str = "_low") -> DataFrame:
    """``rows`` with the text in lower case as a column of its own.

    A generator makes it, since expressions are moved over a projection: searched for each of very many
    terms, the text would be lowered as many times.
    """
    return rows.withColumn(name, F.explode(F.array(F.lower(said))))


def family_rows(rows: DataFrame, said: Column) -> DataFrame:
    """``rows`` once for each service family of which a term occurs in the text, with ``family, n, confidence``."""
    count = lambda terms: reduce(lambda a, b: a + b, [F.coalesce(F.contains(F.col("_low"), F.lit(t)).cast("int"), F.lit(0)) for t in terms])
    found = lowered(rows, said).select(*rows.columns, F.inline(F.array(*[F.struct(F.lit(f).alias("family"), count(t).alias("n")) for f, t in SERVICE_TERMS.items()])))
    return found.filter("n > 0").withColumn("confidence", F.least(F.lit(0.95), 0.72 + 0.06 * F.col("n")))


#: All service terms by family in order, then the generic ones, each once.
CYBER_TERMS = tuple(dict.fromkeys([t for terms in SERVICE_TERMS.values() for t in terms] + list(GENERIC_TERMS)))


def cyber_terms(text: Column) -> Column:
    """All matched terms once, by family in order, then the generic ones."""
    return matched_terms(text, CYBER_TERMS)


def folded(value: Column) -> Column:
    """Lower case for comparing: a sharp s counts as two."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def spaced_name(name: Column) -> Column:
    """Lower case with white space joined."""
    return folded(F.trim(F.regexp_replace(name, r"\s+", " ")))


def postal_code(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]+", "")


def product_key(*parts: Column) -> Column:
    """Normalised parts joined by colons; a missing part is a star."""
    return F.concat_ws(":", *[F.coalesce(spaced_name(p), F.lit("*")) for p in parts])


def host_of(value: Column) -> Column:
    """Host of a URL or bare host: lower case, without user, port, trailing dots and a leading www."""
    rest = F.regexp_replace(F.lower(F.trim(value)), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def canonical_url(value: Column) -> Column:
    """ASCII web addresses: lower-case scheme and host, no default port, no fragment, sorted query, ``/`` for no path."""
    v = F.trim(value)
    part = lambda i: F.regexp_extract(v, r"^(?i:(https?)://)([^/?#@:]+)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$", i)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    default = F.when(scheme == "http", "80").otherwise("443")
    shown = F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, shown, F.when(path == "", "/").otherwise(path), tail))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def credential_marker(text: Column) -> Column:
    """Whether the text shows a private key, an access key or a token."""
    # fixed values: the four patterns
    return text.rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}")


def relevant(*texts: Column) -> Column:
    """Whether any service or generic term occurs in the texts."""
    return F.size(cyber_terms(F.concat_ws(" ", *texts))) > 0


def same_origin(first: Column, second: Column) -> Column:
    """Whether two addresses have the scheme, host and port in common; case and a default port do not count."""
    base = lambda v: F.regexp_extract(canonical_url(v), r"^(https?://[^/?#]+)", 1)
    return F.coalesce((base(first) == base(second)) & (base(first) != ""), F.lit(False))


def version_text(value: Column) -> Column:
    """Version in lower case without surrounding space and without a ``v`` before its number."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), "^v(?=[0-9])", ""), F.lit(""))


def identifier_set(values: Column) -> Column:
    """Sorted distinct identifiers with single spaces, in lower case; blank ones left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, spaced_name), lambda v: v != "")))


def any_url(value: Column) -> Column:
    """As ``canonical_url``, also for addresses with international or IPv6 hosts and for queries to be encoded anew; in Arrow batches."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(_canonical, na_action=None)

    return run(value)


def _canonical(value: str | None) -> str | None:
    try:
        parts = urlsplit((value or "").strip())
        if parts.scheme.lower() not in ("http", "https") or parts.username is not None or not parts.hostname:
            return None
        host = parts.hostname if ":" in parts.hostname else parts.hostname.rstrip(".").encode("idna").decode("ascii")
        shown = f"[{host}]" if ":" in host else host
        scheme, port = parts.scheme.lower(), parts.port
    except (ValueError, UnicodeError):
        return None
    if port and port != {"http": 80, "https": 443}[scheme]:
        shown += f":{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((scheme, shown.lower(), parts.path or "/", query, ""))
