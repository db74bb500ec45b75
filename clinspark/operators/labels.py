"""Outcome labels and the target table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clinspark.config import (
    FOLLOW_UP_DAYS, OVERLAPPING_STAY_SUBJECTS, PROLONGED_HOURS, CohortOptions, Outcome,
)
from clinspark.functions.flags import flag
from clinspark.functions.temporal import elapsed_days, within
from clinspark.operators.cohort import select_cohort


def label_mortality(hosps: DataFrame) -> DataFrame:
    """1 for a death during the stay or on day 0 to 30 after discharge."""
    days = elapsed_days(F.col("dischtime"), F.col("dod"))
    died = within(F.col("deathtime"), F.col("admittime"), F.col("dischtime"))
    return hosps.withColumn("target", flag(died | F.coalesce(days.between(0, FOLLOW_UP_DAYS), F.lit(False))))


def label_prolonged(hosps: DataFrame) -> DataFrame:
    return hosps.withColumn("target", flag(F.col("los_hosp_hr") > PROLONGED_HOURS))


def first_readmissions(hosps: DataFrame) -> DataFrame:
    """``(subject_id, hadm_id, target)`` of each first stay: 1 if the second starts at most 30 days after it.

    Only the first two stays matter; ``row_number() <= 2`` is applied per task before the shuffle.
    """
    order = Window.partitionBy("subject_id").orderBy("admittime", "hadm_id")
    first_two = (
        hosps.select("subject_id", "hadm_id", "admittime", "dischtime")
        .withColumn("_rn", F.row_number().over(order))
        .where("_rn <= 2")
    )
    pair = first_two.groupBy("subject_id").agg(
        F.min_by("hadm_id", "_rn").alias("hadm_id"),
        F.min_by("dischtime", "_rn").alias("_left"),
        F.max(F.when(F.col("_rn") == 2, F.col("admittime"))).alias("_back"),
    )
    label = flag(elapsed_days(F.col("_left"), F.col("_back")) <= FOLLOW_UP_DAYS)
    return pair.select("subject_id", "hadm_id", label.alias("target"))


def label_readmission(hosps: DataFrame) -> DataFrame:
    """The readmission label on first stays, NULL on other stays."""
    return hosps.join(first_readmissions(hosps), ["subject_id", "hadm_id"], "left")


_LABELS = {
    Outcome.MORTALITY: label_mortality,
    Outcome.PROLONGED_STAY: label_prolonged,
    Outcome.READMISSION: label_readmission,
}


def add_label(hosps: DataFrame, outcome: Outcome) -> DataFrame:
    if outcome not in _LABELS:
        raise ValueError(f"unsupported outcome {outcome!r}; choose one of {[o.name for o in Outcome]}")
    return _LABELS[outcome](hosps)


def without_subjects(df: DataFrame, subjects: Sequence[int]) -> DataFrame:
    listed = _ids(df.sparkSession, subjects)
    return df.join(listed, "subject_id", "left_anti")


def _ids(spark: SparkSession, subjects: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(s),) for s in subjects], "subject_id bigint")


def build_target(
    hosps: DataFrame,
    allowed: DataFrame,
    outcome: Outcome,
    options: CohortOptions = CohortOptions(),
    excluded_subjects: Sequence[int] = OVERLAPPING_STAY_SUBJECTS,
) -> DataFrame:
    """``(subject_id, hadm_id, target)``: labels over all admissions, then the cohort, then the exclusions.

    Readmission belongs to the first stay, the only one the cohort keeps, so it is attached per subject; both
    sides are already partitioned by subject.
    """
    if outcome is Outcome.READMISSION:
        labels = first_readmissions(hosps).select("subject_id", "target")
        chosen = select_cohort(hosps, allowed, options).join(labels, "subject_id", "left")
    else:
        chosen = select_cohort(add_label(hosps, outcome), allowed, options)
    return without_subjects(chosen, excluded_subjects).select("subject_id", "hadm_id", "target")


def features_with_target(features: DataFrame, target: DataFrame) -> DataFrame:
    """Inner alignment on both keys."""
    return features.join(target, ["subject_id", "hadm_id"])
