"""Sets of hashed word n-grams, computed for many texts at once with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed together up to about this many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the number of words before it (one more at the end)."""
    buf = np.frombuffer(b" ".join(chunk) + b" ", dtype=np.uint8)
    buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[: len(starts)]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(buf), _ODD)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(buf), _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    words = mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(x) + 1 for x in chunk])
    return words, np.searchsorted(starts, bounds)


def shingle_sets(texts, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams, A-Z lower-cased.

    Words are maximal runs without ASCII white space. With fewer than ``size`` words the whole sequence
    is the only n-gram; without words, or for null, the set is empty.
    """
    chunk: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        if not chunk:
            return
        words, at = _word_hashes(chunk)
        salts = [mix64(np.uint64(i + 1) * _ODD) | np.uint64(1) for i in range(size)]
        n = max(0, len(words) - size + 1)
        grams = mix64(sum((words[i : i + n] * salts[i] for i in range(size)), np.zeros(n, np.uint64)))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1].view(np.int64))
            elif b > a:
                short = np.sum(words[a:b] * np.array(salts[: b - a], dtype=np.uint64)) + np.uint64(b - a)
                yield mix64(np.array([short], dtype=np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)

    with np.errstate(over="ignore"):
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            chunk.append(raw)
            held += len(raw) + 1
            if held >= CHUNK_BYTES:
                yield from flush()
                chunk.clear()
                held = 0
        yield from flush()
