"""Byte-level byte-pair vocabularies: pieces of a text, and merging one piece with a heap over a linked list."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose class can differ between versions of Unicode; the other planes are private or empty.
_PLANES = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
_BLOCK = 512


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def odd_letters(spec: bytes) -> str:
    """A character set of the code points that the library classes otherwise than this process does ('' if there are none).

    The library has its own version of Unicode. Texts with such a character are cut by the library itself.
    """
    from tokenizers import Tokenizer

    cut, mine = Tokenizer.from_str(spec.decode()).pre_tokenizer.pre_tokenize_str, regex.compile(PIECES)
    odd: set[int] = set()
    for i in range(0, len(_PLANES), _BLOCK):
        codes = _PLANES[i : i + _BLOCK]
        probe = "".join(f"a{chr(c)}1!{chr(c)}\n" for c in codes)  # six characters for each code point
        differ = {at for _, at in cut(probe)} ^ {m.span() for m in mine.finditer(probe)}
        odd |= {codes[start // 6] for start, _ in differ}
    runs: list[list[int]] = []
    for c in sorted(odd):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class BytePairs:
    """A vocabulary file (JSON of the ``tokenizers`` library) of the byte-level kind, without normaliser."""

    def __init__(self, spec: bytes, odd: str) -> None:
        told = json.loads(spec)
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or told["normalizer"] or model.get("dropout") or model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("a plain byte-level vocabulary is needed")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        #: Rank of each pair of symbols that merges.
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.spec, self.find = spec, regex.compile(PIECES).findall
        self.is_odd = re.compile(f"[{odd}]").search if odd else None
        self.at_special = re.compile("|".join(map(re.escape, self.special))).split if self.special else None
        self._cut = None

    def pieces(self, text: str) -> list[str]:
        """The pieces that ``text``, which holds no special string, is cut into; nothing merges over their borders."""
        if self.is_odd is None or text.isascii() or not self.is_odd(text):
            return self.find(text)
        if self._cut is None:
            from tokenizers import Tokenizer

            self._cut = Tokenizer.from_str(self.spec.decode()).pre_tokenizer.pre_tokenize_str
        return [text[a:b] for _, (a, b) in self._cut(text)]

    def merges(self, piece: bytes) -> int:
        """How many merges happen in ``piece``: the pair of lowest rank, of equal ones the leftmost, until no pair merges.

        The symbols form a doubly linked list; the heap holds each adjacent pair that ever stood there, and a
        popped one counts only if it still stands. Time grows as n log n with the piece, memory as n.
        """
        n, rank = len(piece), self.rank
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapify(heap)
        done = 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if symbol[i] is None or j < 0 or rank.get((symbol[i], symbol[j])) != r:
                continue
            symbol[i] += symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            done += 1
            if k >= 0:
                before[k] = i
                if (s := rank.get((symbol[i], symbol[k]))) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank.get((symbol[h], symbol[i]))) is not None:
                heappush(heap, (s, h))
        return done
