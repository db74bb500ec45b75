"""The hourly extract: static, hourly measurements and hourly interventions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clinspark.schemas import ICU_KEYS, nan_to_null, require_columns

STATIC, HOURLY, INTERVENTION_HOURS = EXTRACT_GROUPS = ("patients", "vitals_labs_mean", "interventions")


@dataclass(frozen=True)
class ExtractBundle:
    static: DataFrame
    hourly: DataFrame
    interventions: DataFrame

    @property
    def stay_map(self) -> DataFrame:
        """``icustay_id`` to its subject and admission."""
        return self.static.select("icustay_id", "subject_id", "hadm_id").distinct()

    def tables(self) -> dict[str, DataFrame]:
        return dict(zip(EXTRACT_GROUPS, (self.static, self.hourly, self.interventions)))

    @property
    def measured(self) -> list[str]:
        return [c for c in self.hourly.columns if c not in (*ICU_KEYS, "hours_in")]

    @property
    def treated(self) -> list[str]:
        return [c for c in self.interventions.columns if c not in (*ICU_KEYS, "hours_in")]


def read_extract_group(spark: SparkSession, path: str, group: str) -> DataFrame:
    """One of the three extract groups stored as Parquet under ``path``; any other name is refused."""
    if group not in EXTRACT_GROUPS:
        raise ValueError(f"unknown extract group {group!r}; choose one of {list(EXTRACT_GROUPS)}")
    return checked_group(spark.read.parquet(f"{path}/{group}"), group)


def checked_group(df: DataFrame, group: str) -> DataFrame:
    keys = ICU_KEYS if group == STATIC else (*ICU_KEYS, "hours_in")
    return nan_to_null(require_columns(df, keys, group))


def read_extract(spark: SparkSession, path: str) -> ExtractBundle:
    return ExtractBundle(*[read_extract_group(spark, path, g) for g in EXTRACT_GROUPS])
