"""Class-balanced tree ensembles, isotonic calibration, and saving and loading of fitted models."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinspark.config import Learner
from clinspark.operators.preparation import Preparation
from clinspark.operators.sampling import bounded_draws, draw_limits, in_draw
from clinspark.operators.trees import Ensemble, Growth, fit_draws, stage_draws
from clinspark.session import stage_table

_FOREST_PARAMS = {"max_depth", "min_samples_split", "max_features", "n_estimators", "max_bins", "random_state"}
_BOOSTED_PARAMS = {
    "learning_rate", "max_leaf_nodes", "max_iter", "max_depth", "min_samples_leaf", "l2_regularization", "max_bins", "random_state",
}
# Defaults of the histogram boosting this learner stands for.
_BOOSTED_DEFAULTS = {"learning_rate": 0.1, "max_iter": 100, "max_leaf_nodes": 31, "min_samples_leaf": 20}
_FOREST_DEFAULTS = {"max_depth": 30, "min_samples_split": 2, "n_estimators": 100}
_MAX_BINS = 255


def check_params(learner: Learner, params: Mapping[str, Any]) -> None:
    known = {Learner.FOREST: _FOREST_PARAMS, Learner.BOOSTED: _BOOSTED_PARAMS}.get(learner)
    if known is None:
        raise ValueError(f"unsupported learner {learner!r}")
    unknown = set(params) - known
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)} for {learner.name}")


def growth_of(learner: Learner, params: Mapping[str, Any], n_features: int, bags: int) -> Growth:
    """How the trees of one bag grow; the trees of a forest are dealt over the bags."""
    check_params(learner, params)
    if learner is Learner.FOREST:
        p = {**_FOREST_DEFAULTS, **params}
        tried = math.isqrt(n_features) if p.get("max_features") is None else int(p["max_features"])
        return Growth(
            max(1, math.ceil(p["n_estimators"] / bags)), None, p["max_depth"] or 30, None, p["min_samples_split"], 1,
            min(max(1, tried), n_features), bins=p.get("max_bins", _MAX_BINS))
    p = {**_BOOSTED_DEFAULTS, **params}
    return Growth(
        p["max_iter"], float(p["learning_rate"]), p.get("max_depth") or 30, p["max_leaf_nodes"], 2, p["min_samples_leaf"],
        None, float(p.get("l2_regularization") or 0.0), p.get("max_bins", _MAX_BINS))


def to_vectors(df: DataFrame, features: Sequence[str], keep: Iterable[str]) -> DataFrame:
    """Kept columns and one list ``features``.  Missing values of columns that were passed through become 0."""
    named = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]
    return df.select(*[F.col(f"`{k}`") for k in keep], F.array(*named).alias("features"))


def drawn(vectors: DataFrame, label: str, key: str, bags: int, seed: int, most: int | None = None) -> DataFrame:
    """(member, key, label, features): a row per class-balanced draw that a row is in.

    A draw takes as many rows of each class as the smallest has, together ``most`` at most if that is given.
    """
    rows = bounded_draws(vectors.select(key, label, "features"), label, key, seed, bags, most)
    return rows.select(F.col("bag").alias("member"), key, F.col(label).cast("double").alias("label"), "features")


def staged_draws(vectors: DataFrame, label: str, key: str, bags: int, seed: int, width: int) -> list[str]:
    """Files of the rows, with the draws they are in marked: as many rows of each class as the smallest has."""
    limits = draw_limits(vectors, label, key, seed, bags)
    return stage_draws(
        vectors.select(key, label, "features"), label, key, [in_draw(label, key, seed, b, limits) for b in range(bags)], width)


def fit_members(
    vectors: DataFrame, n_features: int, label: str, key: str, learner: Learner, params: Mapping[str, Any], bags: int, seed: int
) -> Ensemble:
    """The trees of all class-balanced draws of ``(key, label, features)``, fitted by one job and written.

    ``vectors`` should be a staged table: it is read several times.
    """
    growth = growth_of(learner, params, n_features, bags)
    files = staged_draws(vectors, label, key, bags, seed, n_features)
    draws = {(b,): (files, b) for b in range(bags)}
    trees = fit_draws(vectors.sparkSession, draws, [growth], n_features, seed, {"member": "int"}).drop("candidate")
    return Ensemble(stage_table(trees, "trees"), learner is Learner.BOOSTED)


def dealt_evenly(df: DataFrame) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def mean_probability(vectors: DataFrame, members: Ensemble, out: str = "raw_score", deal: bool = True) -> DataFrame:
    """Average P(class 1) over the members; adds only the column ``out``.

    Thousands of trees cost far more per row than a shuffle, so rows are dealt evenly over the cores first, unless ``deal``
    is false because they are dealt already.
    """
    if deal:
        vectors = dealt_evenly(vectors)
    return vectors.withColumn(out, members.probability(F.col("features")))


def fit_calibrator(scored: DataFrame, label: str, score: str = "raw_score") -> IsotonicRegressionModel:
    """Isotonic regression on distinct scores weighted by their row count, which gives the same fit."""
    points = stage_table(
        scored.groupBy(F.col(score).alias("score")).agg(
            F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight")
        ),
        "calibration",
    )
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)


def calibrate(df: DataFrame, calibrator: IsotonicRegressionModel, score: str, out: str = "probability") -> DataFrame:
    model = calibrator.copy()
    model.setFeaturesCol(score).setPredictionCol(out)
    return model.transform(df)


@dataclass(frozen=True)
class RiskModel:
    """Preparation, bagged trees and calibrator of one outcome."""

    learner: Learner
    preparation: Preparation
    members: Ensemble
    calibrator: IsotonicRegressionModel

    @property
    def features(self) -> tuple[str, ...]:
        return self.preparation.features

    def raw_scores(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        vectors = to_vectors(self.preparation.transform(df), self.features, keep)
        return mean_probability(vectors, self.members).drop("features")

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns with ``raw_score``, calibrated ``probability`` and ``predicted`` class."""
        calibrated = calibrate(self.raw_scores(df, keep), self.calibrator, "raw_score")
        return calibrated.withColumn("predicted", (F.col("probability") > 0.5).cast("int"))

    def save(self, path: str) -> None:
        """The trees as one table, the calibrator, and last the description, without which nothing is loaded."""
        spark = self.members.table.sparkSession
        self.members.table.write.mode("overwrite").parquet(f"{path}/trees")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        meta = {"learner": self.learner.value, "preparation": self.preparation.to_json()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> RiskModel:
        spark = spark or SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        learner = Learner(meta["learner"])
        return cls(
            learner, Preparation.from_json(meta["preparation"]),
            Ensemble(spark.read.parquet(f"{path}/trees"), learner is Learner.BOOSTED),
            IsotonicRegressionModel.load(f"{path}/calibrator"),
        )
