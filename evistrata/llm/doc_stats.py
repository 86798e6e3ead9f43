"""Numbers that describe one text, the same for every language; no word list, label or source enters."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")

NAMES = (
    "log_words", "mean_word", "distinct_share", "top_word_share", "repeat_next_share", "upper_share", "odd_share",
    "exclaim_share", "digit_share", "edge_mark_share", "lone_mark_share", "period_share", "comma_share", "line_repeat_share", "log_mean_sentence", "short_share",
)


def stats(text: str | None) -> list[float]:
    """One value per name in ``NAMES``; null and empty texts give zeros."""
    words = _WORD.findall(text or "")
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), sum(map(len, words))
    counts = Counter(words)
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) or 1
    lines = [x for x in text.split("\n") if x]
    marks = sum(len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() for w in words)
    lone = sum(not any(map(str.isalnum, w)) for w in words)
    periods = text.count(".") + text.count("?")
    return [
        math.log1p(n), chars / n, len(counts) / n, counts.most_common(1)[0][1] / n, same_next / n, upper / letters, len(_ODD.findall(text)) / chars,
        text.count("!") / n, sum(map(str.isdigit, text)) / chars, marks / n, lone / n, periods / n, text.count(",") / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(n / (periods + 1)), sum(len(w) < 4 for w in words) / n,
    ]


def stats_matrix(texts) -> np.ndarray:
    return np.array([stats(t) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))
