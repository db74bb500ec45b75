"""Training: split, preparation, balanced ensemble, calibration, saving."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, functions as F

from clinspark.config import FINAL_MODELS, OVERLAPPING_STAY_SUBJECTS, Learner, ModelConfig, Outcome
from clinspark.operators.ensembles import (
    RiskModel, check_params, fit_calibrator, fit_members, mean_probability, to_vectors,
)
from clinspark.operators.labels import build_target, features_with_target
from clinspark.operators.preparation import Preparation, column_groups
from clinspark.operators.sampling import stratified_split
from clinspark.operators.scores import ClinicalTables
from clinspark.plans.features import StayTables, aggregate_stays, extract_features
from clinspark.session import stage_table
from clinspark.sources.extract import ExtractBundle

CALIBRATION_SHARE = 0.2


def fit_preparation(data: DataFrame, exclude: tuple[str, ...]) -> Preparation:
    groups = column_groups(data.columns, exclude)
    return Preparation.fit(data, groups.numerical, groups.categorical + groups.interventions)


def train_model(
    data: DataFrame,
    learner: Learner,
    params: Mapping[str, Any],
    label: str = "target",
    key: str = "hadm_id",
    exclude: tuple[str, ...] = ("subject_id", "hadm_id", "target"),
    seed: int = 0,
    bags: int = 100,
) -> RiskModel:
    """Fit one outcome on a table of keys, label and features.

    The feature table and the vectors are written once to the shared folder: split, preparation, every bag
    and the calibration read those files instead of rebuilding the features.
    """
    check_params(learner, params)
    split = stratified_split(stage_table(data, "features"), label, key, seed, CALIBRATION_SHARE)
    training = split.where("is_holdout = 0").drop("is_holdout")
    preparation = fit_preparation(training, exclude)
    keep = [key, label, "is_holdout"]
    vectors = stage_table(to_vectors(preparation.transform(split), preparation.features, keep), "vectors")
    members = fit_members(
        vectors.where("is_holdout = 0"), len(preparation.features), label, key, learner, params, bags, seed
    )
    held_out = mean_probability(vectors.where("is_holdout = 1"), members)
    return RiskModel(learner, preparation, members, fit_calibrator(held_out, label))


@dataclass(frozen=True)
class StudyData:
    """Everything the workflows read."""

    hosps: DataFrame
    bundle: ExtractBundle
    clinical: ClinicalTables


def shared_stays(study: StudyData, allowed: DataFrame, configs: Mapping[Outcome, ModelConfig]) -> dict[int, StayTables]:
    """What the outcomes share of their features: the hourly tables aggregated once."""
    return aggregate_stays(study.bundle, allowed, [c.features for c in configs.values()])


def outcome_features(
    study: StudyData, allowed: DataFrame, config: ModelConfig, stays: Mapping[int, StayTables] | None = None
) -> DataFrame:
    return extract_features(study.bundle, study.hosps, allowed, config.features, study.clinical, stays)


def training_table(
    study: StudyData,
    allowed: DataFrame,
    config: ModelConfig,
    excluded_subjects: tuple[int, ...] = OVERLAPPING_STAY_SUBJECTS,
    stays: Mapping[int, StayTables] | None = None,
) -> DataFrame:
    target = build_target(study.hosps, allowed, config.outcome, config.features.cohort, excluded_subjects)
    return features_with_target(outcome_features(study, allowed, config, stays), target)


def model_path(root: str, outcome: Outcome) -> str:
    return f"{root.rstrip('/')}/{outcome.value}"


def train_all(
    study: StudyData,
    allowed: DataFrame,
    configs: Mapping[Outcome, ModelConfig] = FINAL_MODELS,
    save_to: str | None = None,
) -> dict[Outcome, RiskModel]:
    """One model per configured outcome, each saved under its own path if ``save_to`` is given.

    The base admissions are staged once; every outcome reads them for its cohort and its target.  The hourly tables are
    aggregated once for all outcomes.
    """
    study = replace(study, hosps=stage_table(study.hosps, "hosps"))
    stays = shared_stays(study, allowed, configs)
    models = {}
    for outcome, config in configs.items():
        # Readmission is unknown on later stays, which the raw-event form keeps.
        data = training_table(study, allowed, config, stays=stays).where(F.col("target").isNotNull())
        models[outcome] = train_model(data, config.learner, config.params, seed=config.seed, bags=config.bags)
        if save_to is not None:
            models[outcome].save(model_path(save_to, outcome))
    return models


def load_models(root: str, configs: Mapping[Outcome, ModelConfig] = FINAL_MODELS) -> dict[Outcome, RiskModel]:
    return {outcome: RiskModel.load(model_path(root, outcome)) for outcome in configs}
