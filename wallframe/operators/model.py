"""Pair classifier: fit, score, summary."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.routes import pair_metrics

HIDDEN = 128


def as_training(pairs: DataFrame) -> DataFrame:
    """features, label rows as ML vectors.  ``pairs`` has array ``features`` and 0/1 ``label``."""
    return pairs.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))


def fit_pair_model(
    train: DataFrame, validation: DataFrame, *, inputs: int, hidden: int = HIDDEN, epochs: Sequence[int] = (10, 30), seed: int = 42
):
    """(best model, summary table): one fit per iteration budget, the best validation F1 wins.

    Spark ML's perceptron has a sigmoid hidden layer and is fitted by L-BFGS.
    """
    train, validation = as_training(train).cache(), as_training(validation).cache()
    best, summary = None, []
    for budget in epochs:
        model = MultilayerPerceptronClassifier(layers=[inputs, hidden, 2], maxIter=budget, seed=seed).fit(train)
        scored = model.transform(validation).select(
            (vector_to_array("rawPrediction")[1] - vector_to_array("rawPrediction")[0]).alias("logit"), "label"
        )
        metrics = pair_metrics(scored).first().asDict()
        summary.append({"epoch": budget, **{k: float(v) for k, v in metrics.items()}})
        if best is None or metrics["f1"] > best[0]:
            best = (metrics["f1"], model)
    spark = train.sparkSession
    train.unpersist()
    validation.unpersist()
    return best[1], spark.createDataFrame(summary, "epoch int, loss double, accuracy double, f1 double")


def training_summary(train_pairs: DataFrame, val_pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """One row: image and pair counts with the best epoch."""
    count = lambda df, mark: df.agg(
        F.count_distinct("image_id").alias(f"{mark}_images"), F.count(F.lit(1)).alias(f"{mark}_pairs"), F.lit(1).alias("_k")
    )
    best = fits.groupBy(F.lit(1).alias("_k")).agg(F.max_by(F.struct("epoch", "loss", "accuracy", "f1"), F.struct("f1", -F.col("epoch"))).alias("best"))
    return (
        count(train_pairs, "train").join(count(val_pairs, "val"), "_k").join(best, "_k").select(
            "train_images", "train_pairs", "val_images", "val_pairs", "best.*"
        )
    )


def random_head(inputs: int, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    """Untrained head weights of the right shapes, for callers without a stored model."""
    rng = np.random.default_rng(seed)
    return {
        "w1": rng.normal(0, inputs**-0.5, (inputs, hidden)),
        "b1": np.zeros(hidden),
        "w2": rng.normal(0, hidden**-0.5, hidden),
        "b2": np.zeros(()),
    }
