"""Scoring of unseen subjects on every outcome."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from clinspark.config import FINAL_MODELS, ModelConfig, Outcome
from clinspark.operators.ensembles import RiskModel
from clinspark.plans.features import StayTables
from clinspark.plans.training import StudyData, outcome_features, shared_stays
from clinspark.schemas import STAY_KEYS
from clinspark.sources.tables import cohort_from_ids


def outer_join_predictions(parts: Iterable[DataFrame]) -> DataFrame:
    """Full outer join of per-outcome predictions; a subject outside one cohort is NULL in its column."""
    return reduce(lambda left, right: left.join(right, "subject_id", "full_outer"), parts)


def score_outcome(
    study: StudyData, cohort: DataFrame, config: ModelConfig, model: RiskModel, stays: Mapping[int, StayTables] | None = None
) -> DataFrame:
    """One probability per subject, that of its earliest stay with features.

    The extract may hold later stays of a subject as well; without this step the outer join of the outcomes
    would pair all of them.
    """
    scored = model.score(outcome_features(study, cohort, config, stays), STAY_KEYS)
    timed = scored.join(study.hosps.select(*STAY_KEYS, "admittime"), list(STAY_KEYS), "left")
    order = F.struct(F.col("admittime").isNull(), "admittime", "hadm_id", "probability")
    return timed.groupBy("subject_id").agg(F.min_by("probability", order).alias(config.outcome.value))


def score_unseen_subjects(
    study: StudyData,
    subject_ids: DataFrame | Iterable[int],
    models: Mapping[Outcome, RiskModel],
    configs: Mapping[Outcome, ModelConfig] = FINAL_MODELS,
) -> DataFrame:
    """``(subject_id, mortality_proba, prolonged_LOS_proba, readmission_proba)`` for new subjects.

    The hourly tables are aggregated once for all outcomes and written; the scores are computed when they are asked for.
    """
    cohort = cohort_from_ids(study.hosps.sparkSession, subject_ids)
    stays = shared_stays(study, cohort, configs)
    return outer_join_predictions(
        score_outcome(study, cohort, config, models[outcome], stays) for outcome, config in configs.items()
    )


def outcome_coverage(
    study: StudyData, subject_ids: DataFrame | Iterable[int], configs: Mapping[Outcome, ModelConfig] = FINAL_MODELS
) -> DataFrame:
    """A row per subject that can be scored at all, with 1 in the column of each outcome that has its features."""
    cohort = cohort_from_ids(study.hosps.sparkSession, subject_ids)
    stays = shared_stays(study, cohort, configs)
    return outer_join_predictions(
        outcome_features(study, cohort, config, stays).select("subject_id").distinct().withColumn(outcome.value, F.lit(1))
        for outcome, config in configs.items()
    )
