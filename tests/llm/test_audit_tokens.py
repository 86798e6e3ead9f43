import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evistrata.llm import alignment, filter_audit, pieces, token_counts
from evistrata.llm.byte_pairs import BytePairs, odd_letters

SF = "/root/testdata/sf0.001"
SPEC = pieces.read_model(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "\n", "x<|endoftext|>y<|endoftext|>", "<|endoftext|>", "a͸b !͸ \U00010943\U00010943a", "don't 'SAY  so'\n\n  now\t\t\tx  y", "a▁b", "nul\0byte", "ﬁn é é 漢字かな 한국어 ١٢٣", "x" * 3000, "ab" * 700 + "  " * 300, "​﻿<s> <0x41> <unk>", "🦊🦊 👩‍👩‍👧", " lead", "trail ", "a  b   c", "\x85 \x1c\x1d"]


def random_texts(seed, n):
    rng = random.Random(seed)
    pools = ["abcde ", "aA1!' \n\t", "tshe rn", "éßжя漢 字", [chr(c) for c in range(0x20, 0x3000)], [chr(rng.randrange(0x3000, 0xD800)) for _ in range(50)] + [" "]]
    return ["".join(rng.choice(p) for _ in range(rng.randrange(1, 120))) for p in (rng.choice(pools) for _ in range(n))]


# ---- filter audit


def plain_audit(docs, labels):
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "".join(c for c, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])) if x)  # noqa: B905
        fails.append((s or "", f, i in quality, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                kept = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                all_fail = sum(letter in x[1] for x in mine)
                out[part, order, step] = [len(kept), len(gone), all_fail - len(gone), sum(x[1] == letter for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def told(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in df.collect()]
    found = {r[:3]: r[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_every_order_applied_in_turn(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "BB", "c#", "dd", "Ee", "f", "g|"]) + str(rng.randrange(k)) for _ in range(n)) for n, k in [(10, 3), (60, 5), (60, 100), (200, 100), (55, 1000)] * 4] + ["", None, "low " * 60, " ".join(f"w{i}" for i in range(80))]
    docs = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["s1", "s2", "", None])) for _ in range(200)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)] + [(0, 1, 1), (None, 1, 1), (2, None, None)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, source string, mask string")
    found = told(filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == plain_audit(docs, labels)


def test_audit_of_hot_texts_and_nothing(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(empty, labels)) == {}
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert told(filter_audit.audit(awkward, labels)) == plain_audit(rows, [])
    hot = spark.range(2000).selectExpr("id as doc_id", "'same text' as text", "if(id % 3 = 0, null, 's') as source")
    found = told(filter_audit.audit(hot, labels))
    assert found["s", "EABCD", 1][1] == 1333 and found["", "EABCD", 1][1] == 666


# ---- token counts


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_str(SPEC.decode())
    texts = ODD + random_texts(1, 400)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens string")
    found = {r.doc_id: r for r in token_counts.measure(d, SPEC, limit=20).collect()}
    assert len(found) == len(texts) + 1
    for i, t in enumerate([*texts, ""]):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len(t.encode()), n, n > 20), t
    kept = token_counts.count_tokens(d, SPEC)
    assert kept.columns == d.columns and kept.count() == len(texts) + 1


def test_counts_of_documents(spark, empty, awkward):
    lib = Tokenizer.from_str(SPEC.decode())
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.measure(rows, SPEC).collect()) == want
    assert token_counts.measure(empty, SPEC).collect() == [] and token_counts.measure(awkward, SPEC).count() == awkward.count()


def test_merges_against_a_plain_search_and_bounded_memory():
    v = BytePairs(SPEC, odd_letters(SPEC))

    def plain(raw):
        s = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            best = min(((v.rank[a, b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (a, b) in v.rank), default=None)
            if best is None:
                return len(raw) - len(s)
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    for t in random_texts(2, 200):
        assert v.merges(t.encode()) == plain(t.encode())
    counts = token_counts.Counts(v, most=5)
    assert sum(counts[w] for w in "the cat the dog sat on that mat again".split()) and len(counts) <= 5
    assert v.merges(b"a" * 200_000) > 100_000  # n log n


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}])
def test_other_kinds_of_vocabulary_are_refused(change):
    import json

    with pytest.raises(ValueError):
        BytePairs(json.dumps(json.loads(SPEC) | change).encode(), "")


# ---- alignment


def plain_tokens():
    a = Tokenizer.from_str(SPEC.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    return tokens


def plain_alignment(docs):
    """By byte ranges, every pair of occurrences compared with the next."""
    tokens, parts, held = plain_tokens(), [], Counter()
    for _, text in docs:
        sides = []
        for side in tokens(text):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append(out)
        left, right = sides
        links, j = [], 0
        for i, lo, hi in left:
            while j and right[j - 1][2] > lo:
                j -= 1
            while j < len(right) and right[j][1] < hi:
                if right[j][2] > lo:
                    links.append((i, right[j][0]))
                j += 1
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, lo = [], 0
        for hi in cuts:
            groups.append(",".join(str(i) for i, s, e in left if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in right if lo <= s and e <= hi))
            lo = hi
        held.update(set(links))
        parts.append((len(left), len(right), groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (i, n_a, n_b, len(g), len(ln), sum(held[p] == most[p[0]] for p in ln), sum(held[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (i, _), (n_a, n_b, g, ln) in zip(docs, parts, strict=True)
    ]


@pytest.mark.parametrize("hot", [0, 40, alignment.HOT])
def test_alignment_equals_byte_ranges(spark, hot, monkeypatch):
    docs = list(enumerate([*ODD[:10], *(t[:120] for t in ODD[10:]), None, *random_texts(4, 60), "the cat sat", "the cat sat", "cats and the dogs"])) + [(None, "the cat"), (3, "again the cat")]
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 500)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, pairs int").repartition(3)
    found = alignment.link_counts(d, SPEC, MODEL, hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(plain_alignment(docs))


def test_alignment_of_documents(spark, empty, awkward):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    found = alignment.link_counts(spark.createDataFrame(docs, "doc_id long, text string"), SPEC, MODEL, 1000)
    assert Counter(map(tuple, found.collect())) == Counter(plain_alignment(docs))
    assert alignment.link_counts(empty, SPEC, MODEL).collect() == [] and alignment.link_counts(awkward, SPEC, MODEL).count() == awkward.count()


def test_alignment_itself(spark):
    tokens = plain_tokens()
    texts = ["the cat sat on unbelievable mats", "", None, "zwölf Boxkämpfer"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.align(d, SPEC, MODEL).collect():
        left, right = tokens(texts[r.doc_id])
        assert r.a_ids == [i for i, _ in left] and r.b_ids == [i for i, _ in right] and len(r.link_a) == len(left) + len(right) - len(r.group_a)
        a = b = 0
        for x, y in zip(r.group_a, r.group_b, strict=True):
            assert b"".join(t for _, t in left[a:x]) == b"".join(t for _, t in right[b:y])
            a, b = x, y
        assert a == len(left) and b == len(right) and all(0 <= x < len(left) for x in r.link_a)


def test_tasks_hand_on_sums_and_forget_words(spark, monkeypatch):
    texts = [f"word{i} and word{i % 7} again" for i in range(60)]
    monkeypatch.setattr(alignment, "MOST_PAIRS", 10)
    monkeypatch.setattr(alignment, "REMEMBERED", 4)
    docs = list(enumerate(texts))
    found = alignment.link_counts(spark.createDataFrame(docs, "doc_id long, text string"), SPEC, MODEL, 5)
    assert Counter(map(tuple, found.collect())) == Counter(plain_alignment(docs))
