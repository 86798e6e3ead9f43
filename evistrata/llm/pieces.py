"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text is cut where no piece can cross, then every way to cut a part into pieces is a path through its
lattice. Forward filtering sums the weights of all paths to each position; backward sampling draws the
last piece from them and goes on before it, so each segmentation is drawn with its exact probability.
The draws depend on a seed, the row's key and the place in the text alone.

Spaces are written as U+2581 as the vocabulary does; nothing else is normalised. What no piece covers,
and U+2581 itself, is written as UTF-8 byte pieces, so decoding gives back every text exactly. The
vocabulary file is a parameter: executors read it from a path or from the bytes that travel with the
function; nothing is trained.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.shared import small_batches
from evistrata.llm.shingles import mix64

DEFAULT_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SEED = 11
#: Smoothing: path weights are the product of piece probabilities to this power.
ALPHA = 0.6
#: Characters that are sampled together; bounds the memory of a task.
CHUNK_CHARS = 1 << 17
#: Positions of filtered lattices that a task keeps before it starts anew.
MOST_POSITIONS = 200_000
MARK = "▁"
_OWN_MARK = 0x110000


class PieceVocabulary:
    """Pieces, their weights, and tables to look up every substring of up to the longest piece at once.

    The file's scores rank its pieces; a piece's probability is taken as falling with its rank by Zipf's
    law.
    """

    def __init__(self, model: bytes, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("lossless decoding needs a vocabulary with all byte pieces")
        pieces = {sp.id_to_piece(i): i for i in plain}
        by_score = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = np.empty(n, np.float64)
        rank[by_score] = np.arange(len(by_score))
        self.log_weight = np.full(n + 1, -np.inf)  # the last is that of no piece, -1
        self.log_weight[by_score] = -alpha * np.log(rank[by_score] + 2.7)
        self.byte_log = -alpha * np.log(len(by_score) + 2.7)
        self.longest = max(map(len, pieces))
        #: By hash of two characters: whether some piece may have them side by side.
        self.inside = np.zeros(1 << 22, bool)
        pairs = np.array(sorted({(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.uint32).reshape(-1, 2)
        with np.errstate(over="ignore"):
            self.inside[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.decoded = [b""] * n
        for p, i in pieces.items():
            self.decoded[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.decoded[i] = bytes([b])
        #: Code points of every piece, padded with zeros, and their number.
        self.lengths = np.zeros(n, np.int64)
        self.codes = np.zeros((n, self.longest), np.uint32)
        for p, i in pieces.items():
            self.lengths[i] = len(p)
            self.codes[i, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        # open-address table over the hashes of all pieces
        self.bits = 18
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for p, i in pieces.items():
            h = np.uint64(self.hash_of(p))
            at = int(h >> np.uint64(64 - self.bits))
            while self.ids[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i
        self.probes = 1 + max(((k - int(h >> np.uint64(64 - self.bits))) & ((1 << self.bits) - 1)) for k, h in enumerate(self.keys) if self.ids[k] >= 0)

    _MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def hash_of(self, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * self._MULTIPLIER + np.uint64(ord(c) + 1)
            return int(mix64(h)[0])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        h = mix64(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            ids = self.ids[at]
            same = (self.keys[at] == h[open_]) & (ids >= 0)
            found[open_[same]] = ids[same]
            more = ~same & (ids >= 0)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return found

    def edges(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """``[position, length - 1]``: id of the piece that starts there with that length, -1 if none.

        ``codes`` are code points, ``room`` how many characters the part has left from each position.
        """
        out = np.full((len(codes), self.longest), -1, np.int32)
        h = np.zeros(len(codes), np.uint64)
        fits = np.arange(len(codes))
        for n in range(self.longest):
            fits = fits[room[fits] > n]
            if not len(fits):
                break
            h[fits] = h[fits] * self._MULTIPLIER + (codes[fits + n].astype(np.uint64) + np.uint64(1))
            out[fits, n] = self.lookup(h[fits])
        return out

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece can reach over the place before each character."""
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.inside[self._pair(codes[:-1], codes[1:])]
        return cut

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) ^ b.astype(np.uint64) * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 22)


@lru_cache(maxsize=2)
def _vocabulary(model: bytes, alpha: float) -> PieceVocabulary:
    return PieceVocabulary(model, alpha)


class Lattices:
    """Forward-filtered lattices of the parts seen so far, kept up to a bounded number of positions."""

    def __init__(self, v: PieceVocabulary, most: int = MOST_POSITIONS) -> None:
        self.v, self.most = v, most
        self.shares = np.empty((0, v.longest))  # of the paths to a position, summed over the last piece's length
        self.ids = np.empty((0, v.longest), np.int32)
        self.clear()

    def clear(self) -> None:
        """Forget all parts; the tables stay allocated and are written over."""
        self.base: dict[int, int] = {}
        self.used = 0

    def _room(self, more: int) -> None:
        if len(self.shares) < self.used + more:
            grow = max(len(self.shares) // 2, self.used + more - len(self.shares))
            self.shares = np.concatenate([self.shares, np.empty((grow, self.v.longest))])
            self.ids = np.concatenate([self.ids, np.empty((grow, self.v.longest), np.int32)])

    def add(self, hashes: np.ndarray, codes: np.ndarray, size: np.ndarray) -> None:
        """Filter forward all parts at once, position by position; parts follow one another in ``codes``."""
        v, starts = self.v, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        part = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(codes)) - starts[part]
        edge = v.edges(codes, size[part] - inside)
        # by the place where a piece ends instead of where it starts; a part has size + 1 places in the tables
        base = starts + np.arange(len(size))
        self._room(len(codes) + len(size))
        ids, paths = self.ids[self.used : self.used + len(codes) + len(size)], self.shares[self.used : self.used + len(codes) + len(size)]
        ids[:], paths[:] = -1, -np.inf
        after = np.arange(len(codes)) + part + 1
        for n in range(1, v.longest + 1):
            ends = np.flatnonzero(inside >= n - 1)
            found = edge[ends - (n - 1), n - 1]
            ids[after[ends], n - 1] = found
            paths[after[ends], n - 1] = v.log_weight[found]
        literal = after[edge[:, 0] < 0]
        paths[literal, 0] = v.byte_log * _utf8_length(codes[edge[:, 0] < 0])
        total = np.zeros(len(paths))
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
        for t in range(1, int(size.max()) + 1):
            at = base[order[: alive[t - 1]]] + t
            m = min(t, v.longest)
            block = total[at[:, None] - np.arange(1, m + 1)] + paths[at, :m]
            top = block.max(1)
            weight = np.exp(block - top[:, None]).cumsum(1)
            total[at] = top + np.log(weight[:, -1])
            paths[at, :m] = weight
            paths[at, m:] = weight[:, -1:]
        self.base.update(zip(hashes.tolist(), (base + self.used).tolist(), strict=True))
        self.used += len(paths)

    def sample(self, base: np.ndarray, size: np.ndarray, key: np.ndarray, place: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sample backward, all parts in step: (part, place in it, piece id or -1 for bytes) of the chosen pieces."""
        left = size.copy()
        active = np.flatnonzero(left > 0)
        while len(active):
            at = base[active] + left[active]
            share = self.shares[at]
            u = draws(key[active], place[active] + left[active], seed) * share[:, -1]
            n = np.minimum((share <= u[:, None]).sum(1), self.v.longest - 1) + 1
            left[active] -= n
            yield active, left[active], self.ids[at, n - 1]
            active = active[left[active] > 0]


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def draws(key_hash: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """Reproducible numbers in [0, 1) for (row key, place)."""
    with np.errstate(over="ignore"):
        x = mix64(key_hash.astype(np.uint64) + mix64(np.full(len(place), seed, np.uint64)))
        return (mix64(x ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _part_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    m, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), m)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _misread(v: PieceVocabulary, codes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of chosen pieces whose characters are not those of the text."""
    size = np.diff(np.append(at, len(codes)))
    length = np.where(ids >= 0, v.lengths[ids], 1)
    wrong = [at[size != length]]
    for k in range(int(length.max(initial=0))):
        some = np.flatnonzero((ids >= 0) & (length > k) & (size > k))
        wrong.append(at[some[v.codes[ids[some], k] != codes[at[some] + k]]])
    return np.concatenate(wrong)


def _sample_chunk(lattices: Lattices, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
    v = lattices.v
    true = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not len(true):
        return [np.zeros(0, np.int32) for _ in texts]
    # a mark that stands in the text itself must not be read back as a space
    codes = np.where(true == 32, np.uint32(0x2581), np.where(true == 0x2581, np.uint32(_OWN_MARK), true))
    cut = v.cuts(codes)
    cut[bounds[:-1][bounds[:-1] < len(codes)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(codes))
    hashes = _part_hashes(codes, starts, ends)
    unique, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    if lattices.used > lattices.most:
        lattices.clear()
    new = np.array([i for i, h in enumerate(unique.tolist()) if h not in lattices.base], np.int64)
    if len(new):
        s, size = starts[example[new]], (ends - starts)[example[new]]
        at = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        lattices.add(unique[new], codes[at], size)
    base = np.array([lattices.base[h] for h in unique.tolist()], np.int64)[which.ravel()]
    doc = np.searchsorted(bounds, starts, side="right") - 1
    key = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)[doc]
    chosen = np.full(len(codes), -2, np.int32)
    for part, inside, ids in lattices.sample(base, ends - starts, key, starts - bounds[doc], seed):
        chosen[starts[part] + inside] = ids
    at = np.flatnonzero(chosen != -2)
    wrong = _misread(v, codes, at, chosen[at])
    if len(wrong):  # hashes of two substrings met: such a text is written in bytes
        for d in np.unique(np.searchsorted(bounds, wrong, side="right") - 1).tolist():
            chosen[bounds[d] : bounds[d + 1]] = -1
        at = np.flatnonzero(chosen != -2)
    ids = chosen[at]
    literal = np.flatnonzero(ids == -1)
    times = np.ones(len(at), np.int64)
    times[literal] = _utf8_length(true[at[literal]])
    out = np.repeat(ids, times)
    first = np.cumsum(times) - times
    for c in np.unique(true[at[literal]]).tolist():
        mine = first[literal[true[at[literal]] == c]]
        for k, byte in enumerate(chr(c).encode("utf-8", "surrogatepass")):
            out[mine + k] = v.bytes[byte]
    return np.split(out, np.concatenate([first, [len(out)]])[np.searchsorted(at, bounds[1:-1])])


def sample_pieces(lattices: Lattices, texts: list[str | None], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
    """Piece ids of one sampled segmentation for each text; null gives an empty array."""
    out: list[np.ndarray] = []
    chunk: list[str] = []
    held = first = 0
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for i, t in enumerate(texts):
            chunk.append(t or "")
            held += len(chunk[-1])
            if held >= CHUNK_CHARS or i == len(texts) - 1:
                out += _sample_chunk(lattices, chunk, keys[first : i + 1], seed)
                chunk, held, first = [], 0, i + 1
    return out


def join_pieces(v: PieceVocabulary, ids) -> str:
    """The text that a sequence of pieces was made from."""
    table = v.decoded
    return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, seed: int = SEED, alpha: float = ALPHA, key_col: str = "doc_id", text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a column ``out``: array<int> of the sampled pieces of each whole text.

    The sampling is seeded by ``seed`` and the row's ``key_col``, so equal rows get equal pieces and a
    rerun gives the same. Null and empty texts give an empty array, a null key counts as one more key;
    an empty table gives an empty result; a column of ``docs`` called ``out`` is replaced. The
    vocabulary (some 0.5 MB) travels with the function.
    """
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lattices = Lattices(_vocabulary(model, alpha))
        for keys, texts in batches:
            found = sample_pieces(lattices, texts.to_pylist(), keys.to_pylist(), seed)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))

    small_batches(docs.sparkSession)
    to_pieces = F.arrow_udf(run, "array<int>")
    return docs.withColumn(out, to_pieces(F.xxhash64(F.col(key_col)), F.col(text_col)))


def decode(docs: DataFrame, model: bytes, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """``docs`` with a column ``out``: the text of ``pieces_col``; null pieces give ''."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _vocabulary(model, ALPHA)
        for rows in batches:
            ids, at = np.asarray(rows.values), rows.offsets.to_numpy()
            known = rows.is_valid().to_numpy(zero_copy_only=False)
            yield pa.array([join_pieces(v, ids[a:b].tolist()) if k else "" for a, b, k in zip(at[:-1], at[1:], known, strict=True)], pa.string())

    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(run, "string")(F.col(pieces_col)))


def round_trip(docs: DataFrame, model: bytes, seed: int = SEED) -> DataFrame:
    """Per row ``doc_id, n_pieces, pieces_hash, text_crc32, decoded_crc32, lossless``; null text counts as empty."""
    both = decode(encode(docs.select("doc_id", "text"), model, seed), model)
    text = F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.crc32(text.cast("binary")).alias("text_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == text).alias("lossless"))
