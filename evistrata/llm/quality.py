"""Quality classifier: random Fourier features, ridge from summed normal equations, isotonic calibration.

A Gaussian kernel over standardised document statistics is approximated by cosines of random
projections. Every partition of the labelled rows adds up its own part of the normal equations; only
the sums, whose size is fixed by the number of features, reach the driver. Raw scores are calibrated by
pool-adjacent-violators on a fixed number of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.doc_stats import NAMES, stats_matrix
from evistrata.llm.exact_dedup import digest, keep_winners
from evistrata.llm.shared import materialize, small_batches, summed

FEATURES = 192
WIDTH = 3.0
RIDGE = 1e-3
BINS = 512
SEED = 7


@dataclass(frozen=True)
class QualityModel:
    """``mean`` and ``scale`` of the statistics, the projection, ridge weights, and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cos = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([np.ones((len(x), 1)), z / 8, cos])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps_at, self.steps).clip(0, 1)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence by weighted squares."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = pools[-2:]
            pools[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, digest, stats array<double>`` of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "digest": b["digest"], "stats": list(stats_matrix(b["text"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, digest string, stats array<double>").withColumnRenamed("id", id_col)


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Sum over partitions of ``part(stats, label)``, a matrix of fixed shape; the JVM adds the parts up place by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                got = part(np.vstack(b["stats"].to_numpy()), b["label"].to_numpy(dtype=np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "v": list(total)})

    parts = rows.select("stats", "label").mapInPandas(run, "row int, v array<double>")
    found = summed(parts, "row").toPandas()  # as many rows as the matrix has places
    if not len(found):
        return np.zeros((0, 0))
    out = np.zeros((found["row"].max() + 1, found["pos"].max() + 1))
    out[found["row"], found["pos"]] = found["v"]
    return out


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """Fit on rows ``stats, label`` (0 or 1; null labels are ignored). Without any row every score is 0.5."""
    k = len(NAMES)
    rows = materialize(labelled.filter("label is not null").select("stats", F.col("label").cast("double").alias("label")), "quality-train")
    rng = np.random.default_rng(seed)
    freq, phase = rng.normal(size=(k, features)) / width, rng.uniform(0, 2 * np.pi, features)
    moments = _summed(rows, lambda x, y: np.vstack([np.full(k, float(len(x))), x.sum(0), (x**2).sum(0)]))
    if not len(moments):
        return QualityModel(np.zeros(k), np.ones(k), freq, phase, np.zeros(1 + k + features), np.array([0.0]), np.array([0.5]))
    mean = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 1e-8))
    blank = QualityModel(mean, scale, freq, phase, np.zeros(1 + k + features), np.array([0.0]), np.array([0.5]))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = blank.features(x)
        return np.vstack([np.hstack([z.T @ z, (z.T @ y)[:, None]])])

    sums = _summed(rows, normal)
    n = sums[0, 0]
    weights = np.linalg.solve(sums[:, :-1] + ridge * n * np.eye(len(sums)) * np.r_[0, np.ones(len(sums) - 1)] / features, sums[:, -1])
    fitted = QualityModel(mean, scale, freq, phase, weights, blank.steps_at, blank.steps)
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = fitted.raw(x)
        at = np.clip(np.searchsorted(edges, r) - 1, 0, BINS - 1)
        return np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, r, BINS)])

    count, positive, centre = _summed(rows, histogram)
    some = count > 0
    steps = pool_adjacent(positive[some] / count[some], count[some])
    return QualityModel(mean, scale, freq, phase, weights, centre[some] / count[some], steps)


def score(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """``id_col, digest, score`` for rows ``id_col, digest, stats``. The model has a fixed size and travels with the function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["stats"].to_numpy()) if len(b) else np.zeros((0, len(NAMES)))
            yield pd.DataFrame({"id": b["id"], "digest": b["digest"], "score": model.score(x)})

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(F.col(id_col).alias("id"), "digest", "stats").mapInPandas(run, f"id {kind}, digest string, score double").withColumnRenamed("id", id_col)


def train_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """``doc_id, label`` of the rows that may be learned from; a repeated doc_id counts once, with its largest label."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return labels.filter((rest != held_out) & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, QualityModel]:
    small_batches(docs.sparkSession)
    stats = materialize(document_stats(docs), "quality-stats")
    model = fit(stats.join(train_labels(labels, "quality", 4, 2), "doc_id"))
    return score(stats, model), model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have zero statistics and are scored like any other. Repeated rows are scored
    each; extra columns are ignored; an empty table gives an empty result. Rows with a null doc_id are
    scored and count as not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return _scored(docs, labels)[0].select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``; columns as they came.

    Rows are told apart by doc_id and text. Without any label to learn from nothing is rejected.
    """
    scored, model = _scored(docs, labels)
    if not model.weights.any():
        return docs
    rejected = scored.filter(F.col("score") < threshold).select(F.col("doc_id").alias("id"), "digest", F.lit(1).alias("n"), F.lit(False).alias("wins"))
    return keep_winners(docs, rejected.distinct())
