"""Personal data replaced by keyed surrogates of the same type and format.

Every detected value is brought to a canonical form; equal forms are one entity in the whole corpus. An
entity's surrogate comes from a keyed hash and keeps the type: addresses stay addresses, card numbers
keep their length and check digit, names keep script, case and the gender that their title tells. One
surrogate for two entities, or one that is a real value of the corpus, is drawn anew until all are
distinct. Within a text, names that are parts of a fuller name with a title are the same person, with or
without a title, and get the same parts of its surrogate. Each place gets the surrogate in the form in which the value was written there.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations, count, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm.exact_dedup import digest
from evistrata.llm.html_extract import STOP_WORDS
from evistrata.llm.shared import materialize, small_batches, spare_names

#: Titles that show a person's gender; the capitalised words after one are a name.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: The first letter of a name; a letter with a full stop or alone is an initial.
_UPPER = r"[^\W\d_a-zа-яα-ω]"
_NAME_WORD = re.compile(r"[^\s.]+\.?")
_PART = re.compile(r"\w+(?:-\w+)*")
_PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    ("ip6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|0[1-9](?:[ .]\d{2}){4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    ("name", r"\b(?P<title>" + "|".join(sorted(_GENDER, key=lambda t: (-len(t), t))) + r")\.? (?P<person>(?:U\. ?|U (?=U)){0,3}U\w+(?:[ -](?:U\. ?|U (?=U)){0,2}U\w+){0,2})".replace("U", _UPPER)),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS))
#: A text without any of these has nothing to find.
_MAY = re.compile(r"@|\d[\d .()-]{5}|AKIA|ASIA|[0-9A-Fa-f]:[0-9A-Fa-f]|\b(?:" + "|".join(_GENDER) + r")\b")
#: Attempts after which a surrogate may grow by one more character.
WIDEN = 6
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
_CONSONANTS = {"latin": "bcdfghklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστ"}


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` followed by it pass the Luhn test."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, body: str) -> str:
    """The two check digits that make an account number valid: the whole, read as a number, leaves 1 modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}"


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of all entities of a whole text, in order."""
    if not text or not _MAY.search(text):
        return []
    found = []
    for m in _FIND.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("title", "person") else "name"
        start, end = m.span()
        if m["name"]:
            start, end, kind = *m.span("person"), "name"
        found.append((start, end, kind, canonical(kind, text[start:end], m["title"])))
    return _linked(text, [f for f in found if f[3]])


def _forms(words: tuple[str, ...]) -> set[tuple[str, ...]]:
    """The ways to name a person in part: some of the words in order, those before the last also as initials."""
    found = set()
    for n in range(1, len(words) + 1):
        for some in combinations(words, n):
            if n > 1:
                found |= {(*heads, some[-1]) for heads in product(*((w, w[0]) for w in some[:-1]))}
            elif len(some[0]) > 1 and some[0] not in STOP_WORDS:
                found.add(some)
    return found | {words}


def _linked(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with mentions of one person under one name, the fullest with a title in the text, also where they have no title.

    Of several persons that a mention can mean, it means the one named last before it, else the first after it.
    """
    titled = [(at, *value.split(":", 1)) for at, _, kind, value in found if kind == "name"]
    if not titled:
        return found
    names = {(g, tuple(name.split(" "))) for _, g, name in titled}
    meant: dict[tuple[str, ...], set[tuple[str, tuple[str, ...]]]] = {}
    for g, words in names:
        for form in _forms(words):
            meant.setdefault(form, set()).add((g, words))
    part = {(g, w) for g, w in names if any(o[0] == g and o[1] != w for o in meant[w])}
    places: dict[tuple[str, tuple[str, ...]], list[int]] = {}
    for at, g, name in titled:
        places.setdefault((g, tuple(name.split(" "))), []).append(at)

    def person(form: tuple[str, ...], at: int, gender: str | None = None) -> str:
        whole = [o for o in meant.get(form, ()) if o not in part and gender in (None, o[0])]
        if not whole:
            return ""
        before = {o: bisect_right(places[o], at) for o in whole}
        g, words = min(whole, key=lambda o: ((0, -places[o][before[o] - 1]) if before[o] else (1, places[o][0]), o))
        return f"{g}:{' '.join(words)}"

    out = []
    for start, end, kind, value in found:
        if kind == "name":
            gender, _, name = value.partition(":")
            value = person(tuple(name.split(" ")), start, gender)
        out.append((start, end, kind, value))
    most, known = max(len(w) for _, w in names), {w for form in meant for w in form}
    spans, at, free = iter([*found, (len(text) + 1, len(text) + 1, "", "")]), 0, []
    for start, end, *_ in spans:
        free.append((at, start))
        at = end
    for low, high in free:
        parts = [m for m in _PART.finditer(text, low, min(high, len(text))) if not m[0][0].islower() and m[0].lower() in known]
        i = 0
        while i < len(parts):
            run = 1
            while run < most and i + run < len(parts) and re.fullmatch(r"\.?\s+|\.", text[parts[i + run - 1].end() : parts[i + run].start()]) and (text[parts[i + run - 1].end()] != "." or len(parts[i + run - 1][0]) == 1):
                run += 1
            for n in range(run, 0, -1):
                form = tuple(m[0].lower() for m in parts[i : i + n])
                if form in meant and (who := person(form, parts[i].start())):
                    out.append((parts[i].start(), parts[i + n - 1].end(), "name", who))
                    i += n - 1
                    break
            i += 1
    return sorted(out)


def may_have(text: str) -> Column:
    """The same in the JVM, where it may hold for more texts: only these are joined with their surrogates. Literals are sought one by one, which is faster than a pattern of them all."""
    found = F.col(text).rlike(r"\p{Nd}[\p{Nd} .()-]{5}") | F.col(text).rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")
    for literal in ("@", "AKIA", "ASIA", *_GENDER):
        found = found | F.contains(F.col(text), F.lit(literal))
    return F.coalesce(found, F.lit(False))


def canonical(kind: str, value: str, title: str | None = None) -> str:
    """What all ways to write one entity have in common; '' if the value fails its type's check."""
    if kind in ("email", "ip6"):
        return value.lower()
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return digits if luhn_digit(digits[:-1]) == digits[-1] or len(digits) == 16 else ""
    if kind in ("phone", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        return f"{_GENDER[title]}:{' '.join(w.rstrip('.') for w in _NAME_WORD.findall(value.lower()))}"
    return value


class _Draw:
    """An endless stream of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed, self.block, self.pool = f"{kind}\0{value}\0{attempt}".encode(), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        head, self.pool = self.pool[:4], self.pool[4:]
        return int.from_bytes(head, "big") % n

    def like(self, text: str) -> str:
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def _script(word: str) -> str:
    return "cyrillic" if "а" <= word[0] <= "я" or word[0] == "ё" else "greek" if "α" <= word[0] <= "ω" or word[0] in "άέήίόύώ" else "latin"


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical form of the replacement; the same for the same arguments."""
    d = _Draw(key, kind, value, attempt)
    longer = attempt // WIDEN  # where short forms run out, all kinds but addresses of machines grow
    more = "".join(str(d.below(10)) for _ in range(longer))
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{d.like(local)}{''.join(chr(97 + d.below(26)) for _ in range(longer))}@{domain}"
    if kind == "card":
        body = value[0] + d.like(value[1:-1]) + more
        return body + (luhn_digit(body) if luhn_digit(value[:-1]) == value[-1] else d.like(value[-1]))
    if kind == "key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in range(len(value) - 4 + longer))
    if kind == "phone":  # the country code and the exchange tell the type
        return (value[:1] + d.like(value[1:]) if len(value) <= 10 else value[:-10] + d.like(value[-10:])) + more
    if kind == "iban":
        body = d.like(value[4:]) + more
        return f"{value[:2]}{iban_digits(value[:2], body)}{body}"
    if kind == "ip6":
        return "".join("0123456789abcdef"[d.below(16)] if c != ":" else c for c in value)
    if kind == "name":
        gender, _, words = value.partition(":")
        out = []
        for i, w in enumerate(words.split(" ")):
            script = _script(w)
            n = max(3, len(w)) + longer
            name = "".join((_CONSONANTS if j % 2 == 0 else _VOWELS)[script][d.below(len((_CONSONANTS if j % 2 == 0 else _VOWELS)[script]))] for j in range(n))
            if i == 0:  # a given name ends as most of its gender do
                name = name[:-1] + (_VOWELS[script][0] if gender == "f" else _CONSONANTS[script][d.below(len(_CONSONANTS[script]))])
            out.append(name)
        return f"{gender}:{' '.join(out)}"
    return d.like(value) + more


def written_like(kind: str, replacement: str, original: str, value: str | None = None) -> str:
    """``replacement`` (canonical) in the way in which ``original`` is written; a part of the name ``value`` gets the same part."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(replacement)
        return "".join(next(left, "") if c.isalnum() else c for c in original) + "".join(left)
    if kind == "name":
        words, full = replacement.partition(":")[2].split(" "), (value or "").partition(":")[2].split(" ")
        at = 0

        def same_part(m: re.Match) -> str:
            nonlocal at
            w = m[0].rstrip(".").lower()
            same = [j for j in range(at, len(full)) if full[j] == w] or [j for j in range(at, len(full)) if len(w) == 1 and full[j].startswith(w)]
            at = same[0] if same else at
            word = words[at] if at < len(words) else ""
            at += 1
            return word[:1].upper() + m[0][1:] if len(w) == 1 else _cased(word, m[0])

        return _NAME_WORD.sub(same_part, original)
    if kind == "email":
        return replacement.upper() if original.isupper() else replacement
    return replacement


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:]


def detect(docs: DataFrame) -> DataFrame:
    """``text_key, start, stop, kind, value, written``: every entity of every distinct text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, s, e, kind, v, t[s:e]) for k, t in zip(b["text_key"], b["text"], strict=True) if isinstance(t, str) for s, e, kind, v in find(t)]
            yield pd.DataFrame(rows, columns=["text_key", "start", "stop", "kind", "value", "written"])

    return docs.select(digest("text").alias("text_key"), "text").mapInPandas(run, "text_key string, start int, stop int, kind string, value string, written string").distinct()


def name_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, surrogate``: distinct surrogates of which none is a value of ``entities``; names also without their gender.

    Every round draws for the values that still wait, and one value gets each drawn form. What a round settles is written once. After ``WIDEN``
    rounds forms grow, and with each character there are at least ten times as many, so few rounds are left.
    """

    def draw(attempt: int):
        @F.pandas_udf("string")
        def run(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([surrogate(key, k, v, attempt) for k, v in zip(kind, value, strict=True)], dtype=object)

        return run("kind", "value")

    form = lambda c: F.when(F.col("kind") == "name", F.expr(f"substring({c}, 3)")).otherwise(F.col(c)).alias("form")
    waiting = materialize(entities.select("kind", "value").distinct(), "pii-entities")
    taken = waiting.select("kind", form("value"))
    out: DataFrame | None = None
    for attempt in count():
        drawn = materialize(waiting.withColumn("surrogate", draw(attempt)), "pii-drawn")
        free = drawn.withColumn("form", form("surrogate")).join(taken, ["kind", "form"], "left_anti")
        first = materialize(free.groupBy("kind", "form").agg(F.min(F.struct("value", "surrogate")).alias("r")).select("kind", "r.value", "r.surrogate"), "pii-settled")
        out = first if out is None else out.unionByName(first)
        taken = taken.unionByName(first.select("kind", form("surrogate")))
        waiting = materialize(waiting.join(first, ["kind", "value"], "left_anti"), "pii-waiting")
        if not waiting.limit(1).count():
            return out


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_entities``; other columns as they came.

    Null and empty texts stay as they are with 0 entities. Equal rows get equal texts; the same key
    gives the same surrogates in any run over the same corpus. An empty table gives an empty result. A
    column of ``docs`` called ``n_entities`` is replaced.
    """
    small_batches(docs.sparkSession)
    may = may_have("text")
    spans = materialize(detect(docs.filter(may)), "pii-spans")
    names = name_surrogates(spans, key)
    text_key, places = spare_names(docs, "pii_text_key", "pii_places")
    placed = spans.join(names, ["kind", "value"]).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "value", "written", "surrogate"))).alias(places))
    placed = materialize(placed.withColumnRenamed("text_key", text_key), "pii-places")

    @F.pandas_udf("string")
    def splice(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(texts, places, strict=True):
            if ps is None or len(ps) == 0:
                out.append(t)
                continue
            parts, at = [], 0
            for p in ps:
                parts += [t[at : p["start"]], written_like(p["kind"], p["surrogate"], p["written"], p["value"])]
                at = p["stop"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_entities")]
    # a text in which nothing can be found needs no join
    plain = docs.filter(~may).select(*kept, F.col("text"), F.lit(0).cast("long").alias("n_entities"))
    joined = docs.filter(may).withColumn(text_key, digest("text")).join(placed.hint("merge"), text_key, "left")
    changed = F.when(F.col(places).isNull(), F.col("text")).otherwise(splice("text", F.col(places)))
    found = joined.select(*kept, changed.alias("text"), F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"))
    return plain.unionByName(found)
