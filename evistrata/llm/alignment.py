"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

The ends of the tokens of a text are two bitsets over its bytes. Their AND has the cuts that both share, and counting bits up
to a cut gives the tokens before it, so the cuts make groups of tokens that cover the same bytes. Their OR has one
bit for each pair of tokens that overlap (a link).

How many documents hold a pair linked is a sum over tasks. The most frequent pairs, at most ``HOT`` of them, travel to every
task; the others, each in few documents, are joined by their pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.byte_pairs import BytePairs, byte_letters, odd_letters
from evistrata.llm.shared import materialize, small_batches

#: Characters of texts that are aligned together; bounds the memory of a task.
CHUNK_CHARS = 1 << 20
#: Pieces of up to so many characters are remembered, so many of them at once.
SHORT, REMEMBERED = 64, 350_000
#: Pairs that travel to every task: 16 bytes each.
HOT = 1 << 19
#: Pairs that a task counts before it hands on its sums.
MOST_PAIRS = 1 << 21
_BAD = 0xFFFFFFFF


class _Tokens:
    """Token ids of texts with a space before each; ``table`` has the bytes of each id.

    Pieces over whose borders nothing merges are encoded once for many texts. What the texts of late used is remembered:
    when ``REMEMBERED`` pieces are, they become the older generation, and those that come again move back.
    """

    table: list[bytes]

    def finish(self) -> None:
        self.lengths = np.array([len(b) for b in self.table], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(" " + t) for t in texts]
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, new, once = self.known, self.older, [], {}
        for p in {p for pieces in cut for p in pieces if p not in known}:
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        table, bad = self.table, array("I", [_BAD]).tobytes()
        for p, ids in zip(new, self.encode_pieces(new), strict=True):  # as bytes, four for each id; one bad id where they do not spell the piece
            (known if len(p) <= SHORT else once)[p] = array("I", ids).tobytes() if b"".join([table[i] for i in ids]) == p.encode() else bad
        at = {**known, **once}.__getitem__ if once else known.__getitem__
        return [np.frombuffer(b"".join(map(at, pieces)), "<u4") for pieces in cut]


class BytePairTokens(_Tokens):
    """By a byte-level vocabulary file."""

    def __init__(self, spec: bytes, odd: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks run side by side already
        self.lib = Tokenizer.from_str(spec.decode())
        self.lib.encode_special_tokens = True
        letter = byte_letters()
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.table = [b""] * (1 + max([*vocab.values(), *self.lib.get_added_tokens_decoder()]))
        for piece, i in vocab.items():
            self.table[i] = bytes(letter[c] for c in piece)
        self.pieces = BytePairs(spec, odd).pieces
        self.finish()

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]


class SpacePieceTokens(_Tokens):
    """By a SentencePiece model that adds the space itself.

    Where no piece of the model goes on from another character to a space, nothing crosses there, so a text is encoded word by
    word, each with the spaces before it.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.table = [bytes([int(p[3:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        crossed = any(re.search("[^▁]▁", p) for i, p in enumerate(names) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)))
        self.pieces = (lambda text: [text]) if crossed else re.compile(" *[^ ]+| +").findall
        self.space = lib.piece_to_id("▁")
        self.finish()

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [ids if p != " " else [self.space] for p, ids in zip(pieces, self.lib.encode([p[1:] for p in pieces], num_threads=1), strict=True)]


class _Bits:
    """A bitset over the bytes of a chunk with the number of bits before each word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> _Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray, inclusive: bool) -> np.ndarray:
        """The number of bits before each place, or up to it."""
        mask = np.uint64(_FULL) >> (63 - (places & 63)).astype(np.uint64)
        return self.before[places >> 6] + np.bitwise_count(self.words[places >> 6] & (mask if inclusive else mask >> np.uint64(1)))


_FULL = 0xFFFFFFFFFFFFFFFF


class Aligned:
    """A chunk of texts: ``a, b`` (ids), and for each text where its tokens, groups and links end (``*_at``, from 0).

    ``group_a, group_b``: tokens up to the end of each group; ``link_a, link_b``: the tokens of each link.
    """

    def __init__(self, texts: list[str | None], first: _Tokens, second: _Tokens) -> None:
        none = np.zeros(0, "<u4")
        some = [t for t in texts if t]
        told = zip(first.all_ids(some), second.all_ids(some), strict=True)
        both = [next(told) if t else (none, none) for t in texts]
        both = [(a, b) if len(a) and len(b) and a.max() != _BAD and b.max() != _BAD else (none, none) for a, b in both]
        stops = lambda sizes: np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.a, self.b = (np.concatenate([none, *x]) for x in zip(*both, strict=True)) if both else (none, none)
        self.a_at, self.b_at = (stops([len(x[i]) for x in both]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        bits_a, bits_b = _Bits.of(ends_a - 1, size), _Bits.of(ends_b - 1, size)
        cuts, any_end = _Bits(bits_a.words & bits_b.words), _Bits(bits_a.words | bits_b.words)
        shared, steps = cuts.select(), any_end.select()
        self.group_a, self.group_b = bits_a.rank(shared, True), bits_b.rank(shared, True)
        self.link_a, self.link_b = bits_a.rank(steps, False), bits_b.rank(steps, False)
        last = np.concatenate([[0], ends_a])[self.a_at]  # bytes up to the end of each text
        self.group_at, self.link_at = np.searchsorted(shared, last), np.searchsorted(steps, last)

    def group_texts(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        size_a, size_b = (np.diff(x, prepend=0) for x in (self.group_a, self.group_b))
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.group_a - 1] = last_b[self.group_b - 1] = True
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.repeat(self.group_b - size_b, size_a)] = 3 * self.a.astype(np.int64) + last_a
        codes[np.arange(len(self.b)) + np.repeat(self.group_a, size_b)] = 3 * self.b.astype(np.int64) + 2 * last_b
        at = self.a_at + self.b_at
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            some = codes[x:y].tolist()
            yield b"".join(itemgetter(*some)(_written(int(codes.max()) // 3 + 1)))[:-1] if some else b""


@lru_cache(maxsize=2)
def _written_upto(n: int) -> list[bytes]:
    return [b"%d%s" % (i, s) for i in range(n) for s in (b",", b"|", b";")]


def _written(n: int) -> list[bytes]:
    """Every id with a comma, a bar and a semicolon after it."""
    return _written_upto(1 << max(16, (n - 1).bit_length()))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_CHARS or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0


@lru_cache(maxsize=2)
def _tokenizers(spec: bytes, odd: str, model: bytes) -> tuple[_Tokens, _Tokens]:
    return BytePairTokens(spec, odd), SpacePieceTokens(model)


def align(docs: DataFrame, spec: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the alignment itself: ``id_col, a_ids, b_ids, group_a, group_b, link_a, link_b`` (arrays).

    Group g holds the tokens from ``group_a[g - 1]`` to ``group_a[g]`` of A and likewise of B; link k joins token ``link_a[k]``
    of A with ``link_b[k]`` of B. Null and empty texts and those whose tokens do not spell them have empty arrays.
    """
    odd = odd_letters(spec)
    names = ("a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(spec, odd, model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in _chunks(texts):
                f = Aligned(texts[x:y], first, second)
                per = (f.a_at, f.b_at, f.group_at, f.group_at, f.link_at, f.link_at)
                flat = (f.a, f.b, f.group_a - np.repeat(f.a_at[:-1], np.diff(f.group_at)), f.group_b - np.repeat(f.b_at[:-1], np.diff(f.group_at)), f.link_a - np.repeat(f.a_at[:-1], np.diff(f.link_at)), f.link_b - np.repeat(f.b_at[:-1], np.diff(f.link_at)))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32))) for at, v in zip(per, flat, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *lists], names=[id_col, *names])

    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} array<int>" for n in names))


def _packed(v: np.ndarray) -> bytes:
    """Numbers below 2^32, bytes of equal place side by side, which compress well."""
    return np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _digests(docs: DataFrame, spec: bytes, model: bytes, width: int) -> DataFrame:
    """Per row its counts and ``groups_sha256``, and its distinct linked pairs (ascending, as steps) with how often each is linked.

    A pair is A's id times ``width`` and B's id.
    """
    odd = odd_letters(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(spec, odd, model)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for x, y in _chunks(texts):
                f = Aligned(texts[x:y], first, second)
                links = np.diff(f.link_at)
                key = np.repeat(np.arange(y - x, dtype=np.int64) << 32, links) | (f.a[f.link_a].astype(np.int64) * width + f.b[f.link_b])
                key.sort()
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
                times, key = np.diff(np.append(new, len(key))), key[new]
                at = np.searchsorted(key, np.arange(y - x + 1, dtype=np.int64) << 32).tolist()
                pairs = key & 0xFFFFFFFF
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in f.group_texts()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *[pa.array(np.diff(c), pa.int64()) for c in (f.a_at, f.b_at, f.group_at, f.link_at)], pa.array(digest, pa.string()),
                        pa.array([_packed(np.diff(pairs[i:j], prepend=0)) for i, j in zip(at, at[1:], strict=False)], pa.binary()), pa.array([_packed(times[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary()),
                    ], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    small_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _count_pairs(digests: DataFrame) -> DataFrame:
    """``pair, docs``: documents that hold each pair; tasks hand on sums over as many documents as they can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def settle():
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            waiting.clear()
            both, which = np.unique(np.concatenate([pairs, keys]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, which, np.concatenate([docs, n]))
            return both, total

        told = lambda: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])
        held = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                waiting.append(np.cumsum(_unpacked(raw)))
                held += len(waiting[-1])
                if held >= MOST_PAIRS:
                    pairs, docs = settle()
                    held = 0
                    if len(pairs) >= MOST_PAIRS:
                        yield told()
                        pairs, docs = pairs[:0], docs[:0]
        pairs, docs = settle()
        yield told()

    return digests.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _hot_level(facts: DataFrame, hot: int) -> int:
    """The least number of documents such that at most ``hot`` pairs are in as many or more."""
    level = F.floor(F.log2("docs") * 8).cast("int")
    counted = sorted(((r["level"], r["n"]) for r in facts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 8 rows for each doubling
    total, least = 0, None
    for at, n in counted:
        total += n
        if total > hot:
            break
        least = at
    if least is None:
        return 1 << 62
    return facts.filter(level >= least).agg(F.min("docs")).first()[0]


def _looked_up(digests: DataFrame, hot: pa.Table) -> DataFrame:
    """Per row the sums over its hot pairs, and its other pairs with how often each is linked."""
    known, docs, top = (hot.column(c).to_numpy() for c in ("pair", "docs", "top"))
    order = np.argsort(known)
    shared = digests.sparkSession.sparkContext.broadcast((known[order], docs[order], top[order]))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, top = shared.value
        for batch in batches:
            sums: list[list] = [[], [], [], []]
            for p, t in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
                p, t = np.cumsum(_unpacked(p)), _unpacked(t)
                at = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
                hit = known[at] == p if len(known) else np.zeros(len(p), bool)
                n = t[hit]
                for out, v in zip(sums, (int(n[top[at[hit]]].sum()), int((n * docs[at[hit]]).sum()), p[~hit], t[~hit]), strict=True):
                    out.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(7)], *[pa.array(v, k) for v, k in zip(sums, kinds, strict=True)]], names=[*names, "n_best", "count_sum", "rare", "rare_times"])

    return digests.select(*names, "pairs", "times").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<long>")


def link_counts(docs: DataFrame, spec: bytes, model: bytes, hot: int = HOT) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``spec`` and ``model`` are the contents of a byte-level vocabulary file (A) and of a SentencePiece model (B). Null and empty
    texts, and those whose tokens of A or B do not spell a space and the text, have zeros and ''. A row that repeats is one more
    document; a null ``doc_id`` stays null; extra columns are ignored; an empty table gives an empty result.
    At most ``hot`` pairs are collected and sent to the tasks; those below its level are joined, so any ``hot`` gives the same rows.
    """
    width = len(_tokenizers(spec, odd_letters(spec), model)[1].table)
    digests = materialize(_digests(docs, spec, model, width), "align-digests")
    counts = materialize(_count_pairs(digests), "align-pairs")
    highest = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("most"))
    # one row for each id of A: bounded by its vocabulary
    facts = counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("top"))
    level = _hot_level(counts, hot)
    found = materialize(_looked_up(digests, facts.filter(F.col("docs") >= level).toArrow()), "align-looked-up")
    each = found.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    rest = each.join(facts.filter(F.col("docs") < level), "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("docs")).alias("total"))
    out = found.drop("rare", "rare_times").join(rest, "row", "left")
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "best"), added("count_sum", "total"), "groups_sha256")
