"""Canonical JSON of rows in column functions: sorted keys, no spaces, ASCII only, ISO times, shortest floats; and digests of it.

The text is that of Python's ``json.dumps(value, sort_keys=True, separators=(",", ":"))`` with times as ``isoformat()`` in UTC, so digests
agree with those that collectors make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that JSON writes with a letter.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_PLAIN = r'\A[\x20\x21\x23-\x5B\x5D-\x7E]*\z'


def quoted(text: Column) -> Column:
    """A JSON string; what is not plain ASCII is escaped, beyond U+FFFF as two halves."""

    def one(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        escaped = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(""))
        out = F.when(c.rlike(_PLAIN), c)
        for k, v in _SHORT.items():
            out = out.when(c == k, v)
        return out.otherwise(escaped)

    whole = F.when(text.rlike(_PLAIN), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), ""))
    return F.concat(F.lit('"'), whole, F.lit('"'))


def shortest(x: Column) -> Column:
    """A double with the fewest digits that give it back, in fixed notation from 1e-4 to below 1e16."""
    first = lambda sizes: F.coalesce(*[F.when(t.cast("double") == x, t) for n in sizes for t in [F.format_string(f"%.{n}e", x)]], F.format_string("%.16e", x))
    text = F.when(F.abs(x) < 2.3e-308, first(range(17))).otherwise(first((14, 15, 16)))  # 15 digits hold for all but the smallest
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.rtrim(F.regexp_replace(F.split_part(text, F.lit("e"), F.lit(1)), "[-.]", ""), F.lit("0"))
    e, n = F.split_part(text, F.lit("e"), F.lit(2)).cast("int"), F.length(digits)
    left = lambda k: F.substr(digits, F.lit(1), k)
    fixed = F.when(e >= n - 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).when(e >= 0, F.concat(left(e + 1), F.lit("."), F.substr(digits, e + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    grand = F.concat(left(F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), power)
    zero = F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, zero).otherwise(F.concat(sign, F.when((e >= -4) & (e < 16), fixed).otherwise(grand)))


def _time(at: Column, zone: str) -> Column:
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.lit('"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit(f'{zone}"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON of a value of a type; null for null is ``null``. Times without a zone are UTC."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = shortest(value.cast("double"))
    elif isinstance(kind, T.TimestampNTZType):
        out = _time(value, "+00:00")
    elif isinstance(kind, T.TimestampType):
        out = _time(F.to_utc_timestamp(value, F.current_timezone()), "+00:00")
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, T.StringType):
        out = quoted(value)
    else:
        raise ValueError(f"no canonical form for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def canonical_row(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON object of some columns (all by default) of each row."""
    names = sorted(columns or rows.columns)
    parts = [F.concat(quoted(F.lit(n)), F.lit(":"), canonical_json(F.col(f"`{n}`"), rows.schema[n].dataType)) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of ``canonical_row``: statements with equal content have equal digests, whoever made them."""
    return F.sha2(canonical_row(rows, columns), 256)


# What a claim about an incident says.
INCIDENT_CLAIM = (
    "source_id", "source_kind", "source_record_key", "source_url", "incident_key", "claim_type", "incident_type", "title", "summary", "claimed_organization_name", "organization_id", "organization_link_status",
    "published_at", "modified_at", "occurrence_start_at", "occurrence_end_at", "discovered_at", "confirmed_at", "independence_key", "confidence", "active", "historical_only", "metadata_only", "supersedes_record_key",
)


def incident_claim_digest(claims: DataFrame) -> Column:
    """Digest of a claim by its fixed fields; those that the rows lack are null, identifiers are texts."""
    shaped = {n: (F.col(n) if n in claims.columns else F.lit(None).cast("string"), claims.schema[n].dataType if n in claims.columns else T.StringType()) for n in sorted(INCIDENT_CLAIM)}
    shaped["organization_id"] = (shaped["organization_id"][0].cast("string"), T.StringType())
    parts = [F.concat(F.lit(f'"{n}":'), canonical_json(c, k)) for n, (c, k) in shaped.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)
