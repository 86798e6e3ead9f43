"""Column functions on identifiers and indicators. Invalid values give null."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evistrata.functions.text import canonical_url


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(value)), "[^A-Z0-9]+", "")


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def passes_luhn(digits: Column) -> Column:
    """Luhn test of a string of digits."""
    turned = F.reverse(_digits(digits))
    doubled = F.transform(turned, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Value of a code modulo 97, letters counting as 10 to 35."""
    numbers = F.transform(F.split(value, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda s, d: F.when(d > 9, s * 100 + d).otherwise(s * 10 + d) % 97)


def siren(value: Column) -> Column:
    v = _bare(value)
    return F.when(v.rlike("^[0-9]{9}$"), F.when(passes_luhn(v), v))


def siret(value: Column) -> Column:
    v = _bare(value)
    return F.when(v.rlike("^[0-9]{14}$"), F.when(passes_luhn(v), v))


def lei(value: Column) -> Column:
    v = _bare(value)
    return F.when(v.rlike("^[A-Z0-9]{18}[0-9]{2}$"), F.when(mod97(v) == 1, v))


def registration(value: Column) -> Column:
    """``scheme:value`` told from a prefix or from the length; null if it is none or invalid."""
    bare = F.regexp_replace(value, "^(?i:siren|siret|lei):", "")
    named = F.lower(F.regexp_extract(value, "^(?i:(siren|siret|lei)):", 1))
    v = _bare(bare)
    scheme = F.when(named != "", named).when(v.rlike("^[0-9]{9}$"), "siren").when(v.rlike("^[0-9]{14}$"), "siret").when(F.length(v) == 20, "lei")
    checked = F.when(scheme == "siren", siren(bare)).when(scheme == "siret", siret(bare)).when(scheme == "lei", lei(bare))
    return F.concat(scheme, F.lit(":"), checked)


def hash_key(value: Column, certificate: bool = False) -> Column:
    """``file:md5:...`` and the like, by the number of hexadecimal digits."""
    v = F.replace(F.lower(F.trim(value)), F.lit(":"), F.lit(""))
    kind = F.when(F.length(v) == 32, "md5").when(F.length(v) == 40, "sha1").when(F.length(v) == 64, "sha256")
    return F.when(v.rlike("^[0-9a-f]+$") & kind.isNotNull(), F.concat_ws(":", F.lit("certificate" if certificate else "file"), kind, v))


def fingerprint(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(value)), "[:-]", "")
    return F.when(v.rlike("^([0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$"), v)


def domain(value: Column) -> Column:
    """A public ASCII host name of at least two labels."""
    v = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    label = "[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
    fits = v.rlike(rf"^({label}\.)+{label}$") & ~v.rlike(r"\.(internal|local|localhost)$") & ~v.rlike(r"^[0-9.]+$") & (F.length(v) <= 253) & (v != "localhost.localdomain")
    return F.when(fits, v)


def email(value: Column) -> Column:
    v = F.trim(value)
    local, host = F.regexp_extract(v, "^([^@]*)@[^@]*$", 1), domain(F.regexp_extract(v, "^[^@]*@([^@]*)$", 1))
    return F.when((local != "") & (F.length(local) <= 64), F.concat(F.lower(local), F.lit("@"), host))


def asn(value: Column) -> Column:
    n = F.regexp_extract(F.trim(value), "^(?i:as)?([0-9]{1,10})$", 1)
    number = F.when(n != "", n).cast("bigint")
    return F.when(number.between(1, 4_294_967_295), F.concat(F.lit("AS"), number))


def port(value: Column) -> Column:
    return F.when(value.between(1, 65_535), value)


def protocol(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.rlike("^[a-z0-9][a-z0-9._+-]{0,63}$"), v)


def cloud_resource(value: Column) -> Column:
    """``namespace:resource`` with a lower-case namespace."""
    v = F.trim(value)
    space = F.lower(F.regexp_extract(v, "^([^:]*):", 1))
    return F.when(v.rlike(r"^[^:\s]+:\S+$") & space.rlike("^[a-z][a-z0-9_-]*$") & (F.length(v) <= 500), F.concat(space, F.lit(":"), F.regexp_extract(v, "^[^:]*:(.*)$", 1)))


def contact(channel: Column, value: Column) -> Column:
    """Phone numbers by their digits, everything else in lower case."""
    return F.when(channel == "phone", F.regexp_replace(value, "[^0-9]+", "")).otherwise(F.lower(F.trim(value)))


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a zero byte: idempotency keys."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def name_uuid(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a name in a namespace, the one for URLs unless told otherwise."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Keyed hash of a text, from the two nested digests that define it; no Python on the executors."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Ranges that are not public: this network, private, shared, loopback, link-local, tests, multicast, reserved.
_NOT_PUBLIC = (
    r"^(0|10|127)\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^(22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
)


def ipv4(value: Column) -> Column:
    """A public IPv4 address."""
    v = F.trim(value)
    return F.when(v.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$") & ~v.rlike(_NOT_PUBLIC), v)


def ipv6(value: Column) -> Column:
    """A public IPv6 address in its shortest form, in Arrow batches; the JVM has no function for it."""

    @F.pandas_udf("string")
    def short(values: pd.Series) -> pd.Series:
        return values.map(_short_ipv6, na_action=None)

    return short(value)


def _short_ipv6(value: str | None) -> str | None:
    try:
        address = ipaddress.IPv6Address((value or "").strip())
    except ValueError:
        return None
    return address.compressed.lower() if address.is_global and not address.is_multicast else None


def indicator(kind: Column, value: Column) -> Column:
    """An indicator's comparable form by its kind; null if it is invalid."""
    return (
        F.when(kind == "ipv4", ipv4(value)).when(kind == "ipv6", ipv6(value)).when(kind == "domain", domain(value)).when(kind == "url", canonical_url(value)).when(kind == "file_hash", hash_key(value))
        .when(kind == "certificate_fingerprint", hash_key(value, True)).when(kind == "email_address", email(value))
    )


def asset(kind: Column, value: Column) -> Column:
    """An asset's comparable form by its kind; null if it is invalid."""
    return (
        F.when(kind.isin("domain", "hostname"), domain(value)).when(kind == "ipv4", ipv4(value)).when(kind == "ipv6", ipv6(value)).when(kind == "certificate", fingerprint(value))
        .when(kind == "asn", asn(value)).when(kind == "cloud_resource", cloud_resource(value))
    )


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys: equal rows have equal digests, a null is told from a missing value."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
