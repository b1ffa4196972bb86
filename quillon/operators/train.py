"""Training of pair scorers: a logistic regression over pair features, in place of a neural cross- or bi-encoder.

The trained scorer is a Column expression, so scoring stays inside the JVM like the untrained one.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label
from quillon.functions.vectors import cosine, hashed_encoding, token_overlap
from quillon.operators.evaluate import average_precision, best_threshold, classification_metrics


def cross_features(left: Column, right: Column) -> list[Column]:
    """Features of a pair seen together: token overlap, containment, equality, likeness of lengths and of vectors."""
    a, b = normalize_label(left), normalize_label(right)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return [
        token_overlap(a, b),
        (F.contains(a, b) | F.contains(b, a)).cast("double"),
        (a == b).cast("double"),
        F.least(F.length(a), F.length(b)) / longest,
        1 - F.levenshtein(a, b) / longest,
        cosine(hashed_encoding(a), hashed_encoding(b)),
    ]


def bi_features(left: Column, right: Column) -> list[Column]:
    """The one feature of two texts encoded apart: the likeness of their vectors."""
    return [cosine(hashed_encoding(normalize_label(left)), hashed_encoding(normalize_label(right)))]


FEATURES = {"cross": cross_features, "bi": bi_features}


@dataclass(frozen=True)
class PairModel:
    kind: str
    weights: tuple[float, ...]
    intercept: float
    threshold: float = 0.5

    def scorer(self) -> Callable[[Column, Column], Column]:
        """The pair scorer as a function of two text columns, a probability."""

        def score(left: Column, right: Column) -> Column:
            z = F.lit(self.intercept)
            for w, f in zip(self.weights, FEATURES[self.kind](left, right), strict=True):
                z = z + F.lit(w) * F.coalesce(f, F.lit(0.0))
            return 1 / (1 + F.exp(-z))

        return score


def scored_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(label, score) of training pairs (source_text, target_text, match)."""
    return pairs.select(F.col("match").cast("double").alias("label"), model.scorer()(F.col("source_text"), F.col("target_text")).alias("score"))


def train_pairs(train: DataFrame, val: DataFrame, kind: str = "cross", penalty: float = 0.01, mix: float = 0.0, steps: int = 50) -> PairModel:
    """A model of training pairs; its threshold is the most accurate one on the validation pairs."""
    if kind not in FEATURES:
        raise ValueError(f"no such kind of model: {kind}")
    names = [f"f{i}" for i in range(len(FEATURES[kind](F.lit(""), F.lit(""))))]
    made = FEATURES[kind](F.col("source_text"), F.col("target_text"))
    rows = train.select(F.col("match").cast("double").alias("label"), *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in zip(names, made, strict=True)])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    fitted = LogisticRegression(regParam=penalty, elasticNetParam=mix, maxIter=steps).fit(rows)
    model = PairModel(kind, tuple(map(float, fitted.coefficients)), float(fitted.intercept))
    best = best_threshold(scored_pairs(val, model)).first()
    return model if best is None or best.threshold is None else PairModel(kind, model.weights, model.intercept, float(best.threshold))


def optimize_pairs(train: DataFrame, val: DataFrame, kind: str = "cross", n: int = 8, seed: int = 42) -> tuple[PairModel, DataFrame]:
    """The best of n random settings by average precision on the validation pairs, and a row for each trial."""
    rng, tried, best = random.Random(seed), [], (-1.0, None)
    for trial in range(n):
        penalty, mix = 10 ** rng.uniform(-4, 0), rng.choice([0.0, 0.5, 1.0])
        model = train_pairs(train, val, kind, penalty, mix)
        reached = average_precision(scored_pairs(val, model)).first()[0]
        tried.append((trial, penalty, mix, float(reached)))
        best = max(best, (reached, model), key=lambda x: x[0])
    rows = train.sparkSession.createDataFrame(tried, "trial int, penalty double, mix double, average_precision double")
    return best[1], rows.orderBy(F.desc("average_precision"), "trial")


def evaluate_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """accuracy, precision, recall, f1 and average_precision at the model's threshold."""
    return classification_metrics(scored_pairs(pairs, model), model.threshold)


def save_model(model: PairModel, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(model), f)


def load_model(path: str) -> PairModel:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return PairModel(d["kind"], tuple(d["weights"]), d["intercept"], d["threshold"])
