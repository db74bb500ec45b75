"""Admissions, cohort criteria and the exclusion funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.config import CohortOptions
from clinspark.functions.flags import flag
from clinspark.functions.temporal import age_at, elapsed_hours, within
from clinspark.schemas import require_columns


def base_admissions(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions with chart data joined to their patient, plus age and length of stay in hours."""
    joined = admissions.where("has_chartevents_data = 1").join(patients, "subject_id")
    return joined.select(
        "subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "ethnicity", "gender", "dob", "dod",
        age_at(F.col("admittime"), F.col("dob")).alias("age"),
        elapsed_hours(F.col("admittime"), F.col("dischtime")).cast("double").alias("los_hosp_hr"),
    )


def in_cohort(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows whose subject is in the cohort table."""
    require_columns(df, ["subject_id"], "data")
    return df.join(subjects.select("subject_id"), "subject_id", "left_semi")


def bundle_in_cohort(tables: Sequence[DataFrame], subjects: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(in_cohort(t, subjects) for t in tables)


def first_stay(hosps: DataFrame, mode: str = "nonnull") -> DataFrame:
    """One row per subject, stays ordered by admission time and then id.

    ``nonnull`` takes the first known value of each column, which may come from a later stay; ``row``
    takes the first stay as it is.  Both combine on the map side, so a subject with very many stays
    sends a few rows per task instead of all of them.
    """
    if mode == "row":
        order = Window.partitionBy("subject_id").orderBy("admittime", "hadm_id")
        return hosps.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    if mode != "nonnull":
        raise ValueError(f"unknown first-stay mode {mode!r}")
    columns = [c for c in hosps.columns if c != "subject_id"]
    return hosps.groupBy("subject_id").agg(*[first_known(F.col(f"`{c}`"), c) for c in columns]).select(hosps.columns)


def first_known(value: Column, name: str) -> Column:
    """First non-null value by (admittime, hadm_id); ``min_by`` skips rows whose ordering is NULL."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct("admittime", "hadm_id"))).alias(name)


def _criteria(options: CohortOptions) -> list[tuple[str, Column]]:
    age, los = F.col("age"), F.col("los_hosp_hr")
    stay = (F.col("admittime"), F.col("dischtime"))
    steps = [
        ("age_18_89", age.between(18, 89)),
        ("los_48_240", los.between(48, 240)) if options.cap_los else ("los_48", los >= 48),
        ("not_dead_within_48h", ~(within(F.col("dod"), *stay) & F.coalesce(los < 48, F.lit(False)))),
    ]
    if options.drop_in_hospital_death:
        steps.append(("no_in_hospital_death", ~within(F.col("deathtime"), *stay)))
    return steps


def select_cohort(hosps: DataFrame, allowed: DataFrame, options: CohortOptions = CohortOptions()) -> DataFrame:
    """First stays of allowed subjects that meet every criterion; its subjects are the selected cohort.

    The subject test follows the aggregation, so that rows of one subject are combined before any shuffle;
    Catalyst moves it below where the cohort is small enough to broadcast.
    """
    stays = in_cohort(first_stay(hosps, options.first_stay_mode), allowed)
    for _, condition in _criteria(options):
        stays = stays.where(condition)
    return stays


def cohort_funnel(hosps: DataFrame, allowed: DataFrame, options: CohortOptions = CohortOptions()) -> DataFrame:
    """Rows left after each criterion, ``(step, criterion, n)``: stays at step 0, first stays from step 1 on.

    One pass: the number of stays per subject is kept beside its first stay and summed at the end.
    """
    columns = [c for c in hosps.columns if c != "subject_id"]
    if options.first_stay_mode == "row":
        firsts = [F.min_by(F.col(f"`{c}`"), F.struct("admittime", "hadm_id")).alias(c) for c in columns]
    else:
        firsts = [first_known(F.col(f"`{c}`"), c) for c in columns]
    stays = in_cohort(hosps.groupBy("subject_id").agg(F.count("*").alias("_stays"), *firsts), allowed)

    steps, passed, totals = ["initial_cohort", "first_admission"], F.lit(True), []
    for name, condition in _criteria(options):
        passed = passed & F.coalesce(condition, F.lit(False))
        steps.append(name)
        totals.append(F.sum(flag(passed)))
    counts = stays.agg(
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(f"_n{i}")
          for i, n in enumerate([F.sum("_stays"), F.count("*"), *totals])]
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(name).alias("criterion"), F.col(f"_n{i}").alias("n"))
          for i, name in enumerate(steps)]
    )
    return counts.select(F.inline(rows))
