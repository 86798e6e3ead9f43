"""Token counts by byte-pair merging with a heap over a linked list; no token identifiers are made.

A text is cut into pieces over whose borders nothing merges. The count of a piece is the number of its
bytes less its merges; words repeat, so a task keeps the counts of short pieces, up to a fixed number of them.
Special strings inside a text count one token each, as the library's default has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.byte_pairs import BytePairs, odd_letters
from evistrata.llm.shared import small_batches

#: Tokens above which a document is over the limit.
LIMIT = 1024
#: Pieces of up to so many characters are remembered, so many of them at once.
SHORT, REMEMBERED = 64, 400_000


class Counts(dict):
    """Tokens of a piece; what is not known is counted."""

    def __init__(self, vocabulary: BytePairs, most: int = REMEMBERED) -> None:
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        n = len(raw) - self.vocabulary.merges(raw)
        if len(piece) <= SHORT:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def of_text(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        v = self.vocabulary
        if not any(s in text for s in v.special):
            return sum(map(self.__getitem__, v.pieces(text)))
        parts = v.at_special(text)
        return len(parts) - 1 + sum(self.of_text(p) for p in parts)


def count_tokens(docs: DataFrame, spec: bytes, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``out``: tokens (long) of each whole text, as the library gives them without begin and end.

    ``spec`` is the content of a byte-level vocabulary file; it travels with the function (some 2 MB). Null and
    empty texts have 0 tokens, repeated rows get equal counts, an empty table gives an empty result; a column of
    ``docs`` called ``out`` is replaced, others stay. Nothing is shuffled; a task holds one batch of texts, and a
    piece without a border (a text without spaces) takes memory in proportion to itself.
    """
    odd = odd_letters(spec)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(BytePairs(spec, odd))
        for texts in batches:
            yield pa.array([counts.of_text(t) for t in texts.to_pylist()], pa.int64())

    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(run, "long")(F.col(text_col)))


def measure(docs: DataFrame, spec: bytes, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_bytes`` (UTF-8; null: 0), ``n_tokens, over_limit`` (more than ``limit`` tokens)."""
    counted = count_tokens(docs.select(F.col(id_col), F.col(text_col).alias("text")), spec)
    return counted.select(id_col, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
