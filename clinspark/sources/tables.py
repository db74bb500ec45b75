"""Readers of declared tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from clinspark.config import SEVERITY_SCORES
from clinspark.operators.cohort import base_admissions
from clinspark.schemas import ADMISSIONS, COHORT, PATIENTS, STAY_KEYS, conform, lower_names


def read_csv(spark: SparkSession, path: str, schema: StructType = COHORT) -> DataFrame:
    """A CSV file with a header and a declared schema (cohort ids, item metadata)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def cohort_from_ids(spark: SparkSession, subject_ids: DataFrame | Iterable[int]) -> DataFrame:
    """A cohort from a list of ids, or from any table with a ``subject_id`` column for long lists."""
    if isinstance(subject_ids, DataFrame):
        return conform(subject_ids, COHORT, "cohort")
    return spark.createDataFrame([(int(s),) for s in subject_ids], COHORT)


def load_base_admissions(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Checked admissions and patients tables to the base admissions."""
    return base_admissions(
        conform(lower_names(admissions), ADMISSIONS, "admissions"), conform(lower_names(patients), PATIENTS, "patients")
    )


def load_score_tables(tables: Mapping[str, DataFrame], order: str) -> dict[str, DataFrame]:
    """Narrow projections of the severity tables and ``meld``: keys, score and the tie-break column."""
    return {
        name: lower_names(tables[name]).select(*STAY_KEYS, name, order) for name in (*SEVERITY_SCORES, "meld")
    }
