"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all training texts are taken as unlabelled. A logistic
model over word and word-beginning features minimises
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second part falls below zero, the step
goes the other way, so the model cannot overfit the positives. The vocabulary comes from document
counts over the whole training side, and every gradient step sums over all of it: tasks add up their
rows, the JVM adds up the tasks' vectors, and only vectors as long as the vocabulary reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.quality import train_labels
from evistrata.llm.shared import materialize, small_batches, summed

_WORD = re.compile(r"\w+")
#: Word beginnings of these lengths are features beside the words themselves.
STEMS = (3, 4, 5, 6)
#: Features kept.
VOCABULARY = 2048
#: Words that a task counts before it hands its counts on; bounds its memory.
PARTIAL = 200_000
#: Rows that are packed together for the steps.
PACKED = 8192
#: Least likelihood-ratio statistic of a feature.
EVIDENCE = 12.0
STEPS = 30
RATE = 0.1
PENALTY = 2e-3
SLACK = 0.0


def features(text: str | None) -> set[str]:
    """Lower-cased words and their beginnings (marked ``^``) of the whole text."""
    words = set(_WORD.findall((text or "").lower()))
    found = set(words)
    for n in STEMS:
        found.update("^" + w[:n] for w in words if len(w) >= n)
    return found


class _Numbers(dict):
    """Numbers of the kept features that a word has, itself and its beginnings; words that came before are not looked up again."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= PARTIAL * 2:
            self.clear()
        names = [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]
        self[word] = found = tuple(self.number[f] for f in names if f in self.number)
        return found

    def of_text(self, text: str | None) -> list[int]:
        """The same as the numbers of ``features(text)``, in order."""
        return sorted(set().union(*map(self.__getitem__, set(_WORD.findall((text or "").lower())))))


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.bias + self.weights[r].sum() if len(r) else self.bias for r in rows])

    def ids(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [i for i in map(get, features(text)) if i is not None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _packed(rows: DataFrame) -> DataFrame:
    """``toxic, size, ids`` of many rows (``toxic, ids``) at a time as bytes, so that a step over them costs no more than its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            parts = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["toxic", "size", "ids"])

        n = 0
        for batch in batches:
            lists = batch.column(1)
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(lists.offsets.to_numpy()).astype("<i4"), lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")))
            n += batch.num_rows
            if n >= PACKED:
                yield told()
                n = 0
        if held:
            yield told()

    return rows.mapInArrow(run, "toxic binary, size binary, ids binary")


def _sums(rows: DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """For all ``rows`` (``toxic, ids``) and for the positives: the gradient of the summed loss at label 0 (the last place is that of the bias) and the summed loss itself."""
    return _packed_sums(_packed(rows), w, b)


def _packed_sums(packed: DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """``_sums`` of rows that are packed: the numbers are made in the tasks, the JVM sums them."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 2))
        for batch in batches:
            for t, n, i in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                toxic, at = np.frombuffer(t, np.uint8).astype(np.float64), np.frombuffer(i, "<i4")
                row = np.repeat(np.arange(len(toxic)), np.frombuffer(n, "<i4"))
                z = b + np.bincount(row, w[at], len(toxic))
                slope, loss = _sigmoid(z), np.logaddexp(0, z)
                for side, weight in enumerate((np.ones(len(toxic)), toxic)):
                    total[side] += np.concatenate([np.bincount(at, (slope * weight)[row], size), [(slope * weight).sum(), (loss * weight).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["side", "v"])

    found = summed(packed.mapInArrow(run, "side int, v array<double>"), "side").toPandas()
    out = np.zeros((2, size + 2))
    out[found["side"], found["pos"]] = found["v"]
    return out[0], out[1]


def nnpu(rows: DataFrame, positive: np.ndarray, n_p: int, n_u: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    ``rows`` are the feature numbers ``ids`` of all training texts and whether each is a positive;
    ``positive`` has the number of positives with each feature.
    """
    size = len(positive)
    packed = materialize(_packed(rows.select("toxic", "ids")), "toxicity-packed")
    seen = np.append(positive, n_p) / n_p
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        u, p = _packed_sums(packed, w, b)
        # the slope of the loss at label 1 is that at label 0 less one
        gu, gn = u[:-1] / n_u, prior * p[:-1] / n_p
        negative = u[-1] / n_u - prior * p[-1] / n_p
        g = (gn - prior * seen) + gu - gn if negative >= -SLACK else gn - gu
        g[:-1] += PENALTY * prior * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _count_words(rows: DataFrame) -> DataFrame:
    """``word, dp, du``: texts of the positives and of all ``rows`` (``toxic, text``) with each feature; '' has their numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on_p, on_u = Counter(), Counter()

        def told() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series(list(on_u), dtype=object), "dp": [on_p[w] for w in on_u], "du": list(on_u.values())})
            on_p.clear()
            on_u.clear()
            return out

        for b in batches:
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                found = features(text)
                found.add("")
                on_u.update(found)
                if toxic:
                    on_p.update(found)
                if len(on_u) > PARTIAL:
                    yield told()
        yield told()

    return rows.mapInPandas(run, "word string, dp long, du long").groupBy("word").agg(F.sum("dp").alias("dp"), F.sum("du").alias("du"))


def fit(docs: DataFrame, known: DataFrame, vocabulary: int = VOCABULARY) -> ToxicityModel:
    """The model that ``fit_encoded`` finds."""
    return fit_encoded(docs, docs, known, vocabulary)[0]


def fit_encoded(docs: DataFrame, every: DataFrame, known: DataFrame, vocabulary: int = VOCABULARY) -> tuple[ToxicityModel, DataFrame | None]:
    """The model, and ``doc_id, train, toxic, ids`` of ``every`` text, so that texts need not be read again to be scored; null where there was nothing to learn.

    ``every`` has the rows of ``docs`` and others, told apart by its column ``train`` if it has one. Fit on the positives of ``known`` (``doc_id, label``, materialized) and on unlabelled ``docs``.

    Label 1 is confirmed toxic. All ``docs`` with an id are the unlabelled side whatever their label, so it
    holds toxic texts at their natural rate. The features are chosen by counts over all rows of both
    sides, and all rows take part in every step. The class prior is the share of positives in ``known``.
    Without a positive or without an unlabelled row every score is 0.
    """
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    confirmed = materialize(known.filter("label = 1").select("doc_id", F.lit(True).alias("toxic")), "toxicity-positives")
    # Spark broadcasts the ids of the positives only below its own limit of bytes
    train = F.col("train") if "train" in every.columns else F.lit(True)
    sided = lambda rows: rows.join(confirmed, "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    sides = sided(docs.select("doc_id", "text").filter("doc_id is not null")).select("toxic", "text")
    counted = materialize(_count_words(sides), "toxicity-counts")
    sizes = counted.filter("word = ''").first()
    n_p, n_u = (sizes["dp"], sizes["du"]) if sizes else (0, 0)
    if not n_p or not n_u:
        return ToxicityModel({}, np.zeros(0), -40.0), None
    prior = min(0.9, max(0.01, prior or 0.0))
    counted = counted.filter("word <> ''")
    # words whose presence depends on the side, by the likelihood-ratio statistic of the 2 x 2 table
    p1, u1 = F.col("dp").cast("double"), F.col("du").cast("double")
    cells = [(p1, n_p, "d"), (u1, n_u, "d"), (n_p - p1, n_p, "off"), (n_u - u1, n_u, "off")]
    margin = {"d": p1 + u1, "off": float(n_p + n_u) - p1 - u1}
    g2 = sum((F.when(c > 0, c * F.log(c * float(n_p + n_u) / (float(n) * margin[m]))).otherwise(0.0) for c, n, m in cells), F.lit(0.0)) * 2
    kept = counted.withColumn("g2", g2).filter(F.col("g2") >= EVIDENCE).orderBy(F.col("g2").desc(), "word").limit(vocabulary).select("word", "dp").collect()
    if not kept:
        return ToxicityModel({}, np.zeros(0), float(np.log(prior / (1 - prior)))), None
    number = {r["word"]: i for i, r in enumerate(kept)}

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers(number)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "train": b["train"], "toxic": b["toxic"], "ids": [numbers.of_text(t) for t in b["text"]]})

    texts = sided(every.select("doc_id", "text", (train & F.col("doc_id").isNotNull()).alias("train"))).select("doc_id", "train", "toxic", "text")
    rows = materialize(texts.mapInPandas(narrow, "doc_id bigint, train boolean, toxic boolean, ids array<int>"), "toxicity-features")
    w, b = nnpu(rows.filter("train").select("toxic", "ids"), np.array([r["dp"] for r in kept], np.float64), n_p, n_u, prior)
    return ToxicityModel(number, w, b), rows


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every whole text; the model's size is bounded by its vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = model.logits([model.ids(t) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")


def score_encoded(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of texts whose features ``fit_encoded`` has numbered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = model.logits(list(b["ids"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no features and get the model's base score. Repeated rows are scored
    each; extra columns are ignored; an empty table gives an empty result; a null doc_id counts as not
    held out. Held-out rows take no part in the fit, not even as unlabelled text.
    """
    small_batches(docs.sparkSession)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = materialize(train_labels(labels, "toxic", 5, 0), "toxicity-labels")
    every = docs.select("doc_id", "text", F.coalesce(rest != 0, F.lit(False)).alias("train"))
    model, encoded = fit_encoded(docs.filter(rest != 0), every, known)
    scored = score(docs, model) if encoded is None else score_encoded(encoded, model)
    return scored.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
