"""Reading of fetched documents: titles, links, references, feeds, site maps, archives.

Each function takes one document; Spark spreads the documents. All are pure and never fetch anything.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

_SKIP = frozenset(("script", "style", "noscript", "svg", "template"))
_FEEDS = frozenset(("application/rss+xml", "application/atom+xml", "application/feed+json"))
_REFERENCES = {"link": "href", "script": "src", "form": "action", "a": "href", "img": "src", "iframe": "src", "object": "data", "video": "src", "audio": "src", "source": "src", "embed": "src"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.robots, self.depth, self.in_title = [], None, set(), 0, False
        self.text, self.links, self.feeds, self.references, self.meta = [], [], [], [], {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.depth += tag in _SKIP
        self.in_title = tag == "title"
        if tag == "html":
            self.lang = a.get("lang") or None
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name in ("robots", "googlebot"):
                self.robots |= {x.strip() for x in a.get("content", "").lower().split(",")}
            elif name:
                self.meta.setdefault(name, a.get("content", ""))
        elif tag == "a" and "href" in a and "nofollow" not in a.get("rel", "").lower().split():
            self.links.append(a["href"])
        elif tag == "link" and "alternate" in a.get("rel", "").lower().split() and a.get("type", "").lower() in _FEEDS and "href" in a:
            self.feeds.append(a["href"])
        if _REFERENCES.get(tag) in a:
            self.references.append((tag, a[_REFERENCES[tag]]))

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in _SKIP))
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.depth:
            self.text.append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _decoded(value: str, names: Sequence[str]) -> str:
    return re.sub(f"&(?:{'|'.join(names)});", lambda m: unescape(m[0]), value)


def visible(html: str | None, most: int | None = None, known: tuple[Sequence[str], Sequence[str]] | None = None) -> dict:
    """Title, language, visible text (the title is its beginning) and whether robots may index or archive the page.

    ``known`` names the character references that are decoded in the title and in the text, where they end with a semicolon; all others
    stay as written. Without it all are decoded, as HTML does.
    """
    p = parse(html if known is None else (html or "").replace("&", "&amp;"))
    title, text = "".join(p.title), " ".join(p.text)
    if known is not None:
        title, text = _decoded(title, known[0]), _decoded(text, known[1])
    text = " ".join(text.split())
    return {"title": " ".join(title.split()) or None, "lang": p.lang, "text": text[:most], "noindex": "noindex" in p.robots, "noarchive": "noarchive" in p.robots}


def absolute(links: list[str], base: str, most: int | None = None) -> list[str]:
    """Links resolved against ``base``, without fragments, first seen first, each once; only web addresses."""
    found: dict[str, None] = {}
    for link in links:
        try:
            url = urljoin(base, link.strip()).partition("#")[0]
            if urlsplit(url).scheme in ("http", "https") and urlsplit(url).hostname:
                found.setdefault(url)
        except ValueError:
            continue
    return list(found)[:most]


def page_links(html: str | None, base: str, most: int | None = None) -> list[str]:
    return absolute(parse(html).links, base, most)


def feed_links(html: str | None, base: str, most: int | None = None) -> list[str]:
    return absolute(parse(html).feeds, base, most)


def references(html: str | None, base: str) -> list[tuple[str, str]]:
    """(kind of element, address) of everything that a page points to."""
    return [(tag, u[0]) for tag, link in parse(html).references if (u := absolute([link], base))]


def _safe_xml(body: str):
    if re.search(r"<!DOCTYPE|<!ENTITY", body, re.I):
        return None
    try:
        return ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return None


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def site_map(body: str) -> list[tuple[str, str]]:
    """(``page`` or ``index``, address) in document order, each once; document types are refused."""
    root, found = _safe_xml(body), {}
    for entry in root if root is not None else ():
        for child in entry:
            if _plain(child.tag) == "loc" and (child.text or "").strip():
                found.setdefault((("index" if _plain(entry.tag) == "sitemap" else "page"), child.text.strip()))
    return list(found)


def feed(body: str) -> list[tuple[str, str, str]]:
    """(address, title, published) of the entries of an RSS or Atom feed."""
    root, found = _safe_xml(body), []
    for item in root.iter() if root is not None else ():
        if _plain(item.tag) in ("item", "entry"):
            got = {_plain(c.tag): (c.get("href") or c.text or "").strip() for c in reversed(item)}
            if got.get("link"):
                found.append((got["link"], got.get("title", ""), got.get("pubdate") or got.get("published") or got.get("updated") or ""))
    return found


def contact_file(body: str) -> list[tuple[str, str]]:
    """(field, value) lines of a security contact file, comments left out."""
    lines = (line.partition(":") for line in body.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return [(k.strip().lower(), v.strip()) for k, sep, v in lines if sep and v.strip()]


def office_text(body: bytes, most_bytes: int = 50_000_000, most_ratio: int = 200) -> str | None:
    """Text of a zipped office document; null if it is none or unpacks beyond the bounds."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            members = [i for i in z.infolist() if re.fullmatch(r"(word/document|xl/sharedStrings|ppt/slides/slide\d+)\.xml", i.filename)]
            parts = sorted(members, key=lambda i: i.filename)
            if sum(i.file_size for i in parts) > most_bytes or any(i.file_size > most_ratio * max(1, i.compress_size) for i in parts):
                return None
            roots = [_safe_xml(z.read(i).decode("utf-8", "replace")) for i in parts]
            return " ".join(" ".join((t.text or "") for t in r.iter() if _plain(t.tag) == "t") for r in roots if r is not None)
    except zipfile.BadZipFile:
        return None


def zipped_csv(body: bytes, delimiter: str = ";", most_bytes: int = 500_000_000) -> list[dict[str, str]]:
    """Rows of all CSV files in an archive; members that leave the archive or are too large are refused."""
    rows: list[dict[str, str]] = []
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for i in z.infolist():
            if not i.filename.lower().endswith(".csv"):
                continue
            if i.filename.startswith("/") or ".." in i.filename.split("/") or i.file_size > most_bytes:
                raise ValueError(f"refused archive member {i.filename}")
            rows += csv.DictReader(io.StringIO(z.read(i).decode("utf-8-sig")), delimiter=delimiter)
    return rows


_TIMES = {"article:published_time": "published", "article:modified_time": "updated"}
_SECRET = re.compile(r"pass|token|secret|api_?key|authorization|cookie|session", re.I)
MOST_JOB_TEXT = 20_000


class _Structured(HTMLParser):
    """The bodies of scripts that hold linked data."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.bodies = False, []

    def handle_starttag(self, tag, attrs):
        self.open = tag == "script" and (dict(attrs).get("type") or "").lower() in ("application/ld+json", "application/json")
        if self.open:
            self.bodies.append("")

    def handle_endtag(self, tag):
        self.open = self.open and tag != "script"

    def handle_data(self, data):
        if self.open:
            self.bodies[-1] += data


def _leaves(value, key: str = ""):
    """(key, text) of all texts in a JSON value; what hangs on a key that names a secret is left out."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not _SECRET.search(k):
                yield from _leaves(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, key)
    elif isinstance(value, str) and value.strip():
        yield key, " ".join(value.split())


def semantics(html: str | None) -> dict:
    """What a page says of itself in meta elements and linked data: title, times, texts, number of records."""
    meta = parse(html).meta
    reader = _Structured()
    reader.feed(html or "")
    reader.close()
    found = {"title": next((meta[k].strip() for k in ("og:title", "twitter:title") if meta.get(k, "").strip()), None), "published": None, "updated": None, "records": 0}
    found |= {to: meta[k].strip() or None for k, to in _TIMES.items() if k in meta}
    texts: dict[str, None] = {}
    for body in reader.bodies:
        try:
            leaves = list(_leaves(json.loads(body)))
        except ValueError:
            continue
        found["records"] += 1
        texts |= dict.fromkeys(v for _, v in leaves)
        for key, to in (("datePublished", "published"), ("dateModified", "updated")):
            found[to] = found[to] or next((v for k, v in leaves if k == key), None)
    return found | {"structured_text": " ".join(texts)}


def job_text(html: str | None) -> str:
    """Visible text of a job description, bounded."""
    return " ".join(" ".join(parse(html).text).split())[:MOST_JOB_TEXT]


def plain_text(body: bytes, most: int = 1_000_000) -> str | None:
    """Text of a plain file with white space joined; null for binary content."""
    return None if b"\0" in body[:4096] else " ".join(body[: 4 * most].decode("utf-8", "replace").split())[:most]


OFFICE = tuple(f"application/vnd.openxmlformats-officedocument.{k}" for k in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))


def public_content(mime: str | None, body: bytes) -> tuple[str | None, str | None]:
    """(title, text) of a fetched body by its type; nulls for a type that has no reader."""
    kind = (mime or "").partition(";")[0].strip().lower()
    if kind == "text/html":
        page = body.decode("utf-8", "replace")
        seen = visible(page)
        return semantics(page)["title"] or seen["title"], seen["text"]
    if kind == "text/plain":
        return None, plain_text(body)
    return None, office_text(body) if kind in OFFICE else None
