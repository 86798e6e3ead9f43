import math
import random
import re
from collections import Counter

import pytest

from evistrata.llm import html_extract, pieces, surrogates

SF = "/root/testdata/sf0.01"
PROSE = "The cat and the dog of the house were in a box that was on the table with it, and this is not what they have for you. " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<div><br></div>", ""), ("<p>A &amp; B&nbsp;&#67;</p>", "A & B C"),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><p>short end.</p></article><footer>&copy; x</footer>", f"Title {PROSE.strip()} short end."),
        (f"<div class='cookie-notice'>{PROSE}</div><div class=content><p>{PROSE}<p>{PROSE}</div><div id=comments>{PROSE}</div>", f"{PROSE.strip()} {PROSE.strip()}"),
        ("<article><p>tiny</p><section class=comments><p>nice</p></section><form><label>Name</label></form></article>", "tiny"),
        ("<p>a<script>var x='</p>'</script> b<style>p{}</style></p>", "a b"),
        (f"<ul><li><a href=1>{PROSE}</a></li></ul><p>{PROSE}</p>", PROSE.strip()),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_short_blocks_follow_their_neighbours():
    marks = [html_extract.Block(PROSE * 2, 0, 0, False, False), html_extract.Block("short", 0, 0, False, False), html_extract.Block(PROSE * 2, 0, 0, False, False), html_extract.Block("tail", 0, 0, False, False), html_extract.Block("links", 5, 0, False, False)]
    for b in marks:
        b.label = html_extract.first_pass(b)
    html_extract.second_pass(marks)
    assert [b.label for b in marks] == ["good", "good", "good", "bad", "bad"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as h

    for r, p in zip(html_extract.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        assert r.text == " ".join(h.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>hi", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in html_extract.extract(odd).collect()) == ["", "", "hi"]


TEASER = "Ten more things that you have to know of the city and of the people in it, told by those who were there for it."
MIDDLE = "It was the first of the bridges that they had in the town, and it is the last one to be shut for the winter."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class='entry'><p>{PROSE}</p><p>{PROSE}</p></div><div id='comments'><ol><li><article class='comment-body'><p>{PROSE * 3}</p></article></li><li><article class='comment-body'><p>{PROSE}</p></article></li></ol></div>", f"{PROSE}{PROSE.strip()}"),
        (f"<div class='entry'><p>{PROSE}</p></div><section class='related'><article><h3>More</h3><p>{TEASER}</p></article></section>", PROSE.strip()),
        (f"<main><p>{PROSE}</p></main><article class='comment'><p>{PROSE * 2}</p></article>", PROSE.strip()),
        (f"<article class='post'><p>{PROSE}</p></article><article class='teaser'><p>{TEASER}</p></article>", PROSE.strip()),
        (f"<body><form id='aspnetForm' action='x'><div class='menu'><a href=/>Home</a></div><div><h1>Title</h1><p>{PROSE}</p><p>short end.</p></div><input name=q></form></body>", f"Title {PROSE.strip()} short end."),
        (f"<form action=x><article><p>{PROSE}</p><form class=comment-form><p>{TEASER}</p></form></article></form>", PROSE.strip()),
        (f"<h1>Bridge to close</h1><p>{MIDDLE}</p><p>So it goes.</p><p>{MIDDLE}</p>", f"Bridge to close {MIDDLE} So it goes. {MIDDLE}"),
        (f"<div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><article><p>{TEASER}</p></article></div>", f"{PROSE * 4}{TEASER}"),
        (f"<div><article class='card'><p>{PROSE}</p></article><article class='card'><p>{PROSE}</p></article></div>", f"{PROSE}{PROSE.strip()}"),
        ("<form><label>Name</label><input><label>Mail</label><button>Send</button></form>", ""),
    ],
)
def test_what_the_page_holds_most_of_is_its_text(html, text):
    assert html_extract.main_text(html) == text


LINKED = "See the <a href=/r>report</a> for the full list of the results."
POLISH = "Rada miasta przyjęła wczoraj nowy budżet, który przewiduje większe wydatki dotyczące szkół oraz transportu publicznego. " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p>{PROSE}</p><p>{LINKED}</p><h2>The <a href=/x>next</a> big part</h2><p>{PROSE}</p></article>", f"{PROSE}See the report for the full list of the results. The next big part {PROSE.strip()}"),
        (f"<p>{PROSE}</p><p>Copyright {PROSE}</p><p>Copyright 2020 Us</p>", f"{PROSE}Copyright {PROSE.strip()}"),
        (f"<div><a href=/>Start</a></div><h1>Budżet</h1><p>{POLISH}</p><p>{POLISH}</p><div><a href=/>Kontakt</a></div>", f"Budżet {POLISH}{POLISH.strip()}"),
    ],
)
def test_short_linked_copyright_and_unknown_language(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class='site has-sidebar'><div class=c><p>{PROSE}</div><div class=sidebar>{PROSE}</div></div>", PROSE.strip()),
        (f"<article class='post category-legal tag-search'><p>{PROSE}</p></article>", PROSE.strip()),
        (f"<main id=search><p>{PROSE}</p><div class=related>{PROSE[:120]}</div></main>", PROSE.strip()),
        (f"<div class=legal-page><div><p>{PROSE}<p>{PROSE}</div><div class=footer>{PROSE[:120]}</div></div>", f"{PROSE}{PROSE.strip()}"),
        (f"<div class=widget><article><p>{PROSE}</article><div class=comments><article>{PROSE * 9}</article></div></div>", f"{PROSE.strip()}"),
        (f"<article><p>{PROSE}</article><div id=comments><article class=c>{PROSE * 9}</article></div>", PROSE.strip()),
        (f"<html><head><title>T</title><body><p>{PROSE}</p></body></html>", PROSE.strip()),
        (f"<html><head><title>T</title></head><body><div class=nav>{PROSE[:120]}</div><p>{PROSE}</p></body></html>", PROSE.strip()),
    ],
)
def test_names_of_wrappers_and_open_head(html, text):
    assert html_extract.main_text(html) == text


MODEL = pieces.read_model(pieces.DEFAULT_MODEL)


def test_round_trip(spark, awkward, empty):
    got = pieces.round_trip(awkward, MODEL).collect()
    assert len(got) == 10 and all(r.lossless for r in got)
    assert pieces.round_trip(empty, MODEL).count() == 0
    assert pieces.round_trip(spark.read.parquet(f"{SF}/documents.parquet"), MODEL).filter("not lossless").count() == 0


def test_samples_have_their_exact_probability():
    v = pieces.PieceVocabulary(MODEL)
    got = Counter(tuple(x.tolist()) for x in pieces.sample_pieces(pieces.Lattices(v), ["a cat"] * 40_000, list(range(40_000)), 1))
    ids = {v.decoded[i].decode().replace(" ", pieces.MARK): i for i in range(len(v.decoded)) if math.isfinite(v.log_weight[i])}
    text, paths = f"a{pieces.MARK}cat", {}

    def walk(at, path, weight):
        if at == len(text):
            paths[tuple(path)] = math.exp(weight)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ids:
                walk(end, [*path, ids[text[at:end]]], weight + v.log_weight[ids[text[at:end]]])

    walk(0, [], 0.0)
    total = sum(paths.values())
    assert set(got) <= set(paths) and max(abs(got[p] / 40_000 - w / total) for p, w in paths.items()) < 0.01


def test_sampling_depends_on_the_key_alone():
    v = pieces.PieceVocabulary(MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde \n.") for _ in range(rng.randrange(400))) for _ in range(50)]
    one = pieces.sample_pieces(pieces.Lattices(v), texts, list(range(50)))
    turned = pieces.sample_pieces(pieces.Lattices(v, 10), texts[::-1], list(range(50))[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(one, turned, strict=True))
    other = pieces.sample_pieces(pieces.Lattices(v), texts, list(range(100, 150)))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(one, other, strict=True))


TEXT = "Mail Ann.Lee@mail.example.com or ann.lee@mail.example.com, call +1 (446) 555-8962, host 10.2.3.4, card 4532 0151 1283 0366. Frau Maria Keller met Mr. Иван."


def test_surrogates_keep_type_and_format():
    kinds = [k for *_, k, _ in surrogates.find(TEXT)]
    assert kinds == ["email", "email", "phone", "ip", "card", "name", "name"]
    for _, _, kind, value in surrogates.find(TEXT):
        got = surrogates.surrogate(b"k", kind, value, 0)
        assert got == surrogates.surrogate(b"k", kind, value, 0) != surrogates.surrogate(b"other", kind, value, 0)
        if kind == "card":
            assert len(got) == 16 and surrogates.luhn_digit(got[:-1]) == got[-1]
        if kind == "name":
            assert got[:2] == value[:2] and len(got.split()) == len(value.split())
            assert ("а" <= got[2] <= "я") == ("а" <= value[2] <= "я")
            assert (got.partition(":")[2].split()[0][-1] in "aа") == (got[0] == "f")
    assert surrogates.written_like("card", "1234567890123456", "4532 0151-1283 0366") == "1234 5678-9012 3456"


def test_surrogates_in_documents(spark, awkward, empty):
    docs = spark.createDataFrame([(1, TEXT), (2, "no data"), (3, TEXT.replace("10.2.3.4", "10.2.3.5")), (4, None), (4, None)], "doc_id long, text string")
    by = {r.doc_id: r for r in surrogates.replace(docs, b"k").collect()}
    assert by[2].text == "no data" and by[4].text is None and by[1].n_entities == 7
    for value in ("Ann.Lee", "ann.lee", "555-8962", "10.2.3.4", "4532", "Maria", "Иван"):
        assert value not in by[1].text
    changed = re.sub(r"\d+\.\d+\.\d+\.\d+", "", by[1].text) == re.sub(r"\d+\.\d+\.\d+\.\d+", "", by[3].text)
    assert changed and by[1].text != by[3].text  # one entity, one surrogate; two entities, two
    a, b = re.findall(r"\S+@mail\.example\.com", by[1].text)
    assert a.rstrip(",") == b.rstrip(",")
    assert surrogates.replace(awkward, b"k").count() == 10 and surrogates.replace(empty, b"k").count() == 0


def test_collisions_are_drawn_anew(spark):
    small = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(0, 400)], "kind string, value string")
    got = surrogates.name_surrogates(small, b"k").collect()
    assert len({r.surrogate for r in got}) == 400 and not {r.surrogate for r in got} & {r.value for r in got}


def test_parts_of_a_name_are_one_person(spark):
    text = "Mr John Smith met Mr J. Smith. Mr Smith left; Smith, SMITH and John Smith's dog too. Mrs Smith and smith stay. Frau Keller"
    found = surrogates.find(text)
    assert [(text[a:b], v) for a, b, _, v in found] == [
        ("John Smith", "m:john smith"), ("J. Smith", "m:john smith"), ("Smith", "m:john smith"), ("Smith", "m:john smith"), ("SMITH", "m:john smith"),
        ("John Smith", "m:john smith"), ("Smith", "f:smith"), ("Keller", "f:keller"),
    ]
    got = surrogates.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first().text
    given, family = re.match(r"Mr (\w+) (\w+) met", got).groups()
    assert got.startswith(f"Mr {given} {family} met Mr {given[0]}. {family}. Mr {family} left; {family}, {family.upper()} and {given} {family}'s dog too.")
    two = "Mr Adam Smith and Mr John Smith. Mr Smith spoke. Mr. J.R. Miller"
    assert [v for *_, v in surrogates.find(two)] == ["m:adam smith", "m:john smith", "m:john smith", "m:j r miller"]


def test_article_text_is_not_lost():
    said = "This is a paragraph of the article and it has many of the usual words in it so that it is clearly a part of the main text of the page, as it should be."
    page = lambda body: html_extract.main_text(f"<html><body>{body}</body></html>")
    for name in ("post legal-analysis", "search-engines"):
        assert page(f'<article class="{name}"><p>{said}</p></article>') == said
    law = "Copyright law in the EU is a field that has grown in the last years and it is a subject of many of the debates, as the text of the law shows in its detail."
    assert page(f"<article><p>{said}</p><p>{law}</p></article>") == f"{said} {law}"
    assert page(f"<article><p>{said}</p><p>See <a href=x>the report</a> for details.</p><p>{said}</p></article>") == f"{said} See the report for details. {said}"
    assert page(f'<article><p>{said}</p><svg class="i" /><p>two {said}</p></article>') == f"{said} two {said}"
    unspaced = "\u8fd9\u662f\u4e00\u4e2a\u5173\u4e8e\u7ecf\u6d4e\u53d1\u5c55\u7684\u6587\u7ae0" * 20
    assert page(f"<div><p>{unspaced}</p><p>{unspaced}</p></div>") == f"{unspaced} {unspaced}"


def test_short_forms_do_not_run_out(spark):
    values = [("phone", f"3{i:04d}") for i in range(8000)] + [("key", "AKIA" + f"{i:016d}") for i in range(50)] + [("ssn", f"{i:09d}") for i in range(50)] + [("name", f"{g}:{w}") for g in "mf" for w in ("bob", "abo", "eve")]
    found = surrogates.name_surrogates(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert len(found) == len(values) and {(r.kind, r.value) for r in found} == set(values)
    form = lambda kind, v: v[2:] if kind == "name" else v
    real, drawn = {(k, form(k, v)) for k, v in values}, [(r.kind, form(r.kind, r.surrogate)) for r in found]
    assert len(set(drawn)) == len(drawn) and not real & set(drawn)
    assert surrogates.written_like("phone", "371234", "+3 71 23") == "+3 71 234"
