"""One-hot encodings with a fixed list of columns, so that no schema depends on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.config import ADMISSION_TYPES, ETHNICITY_GROUPS, FIRST_CARE_UNITS, INSURANCE_TYPES
from clinspark.functions.flags import dnr_flag, flag, gender_flag


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """Replace ``column`` by one 0/1 column per listed value; any other value gives all zeros."""
    return df.withColumns({f"{prefix}_{v}": flag(F.col(column) == v) for v in values}).drop(column)


def ethnicity_group(raw: Column) -> Column:
    """Map free text to a group by its first word.

    'other' is given only if none of the group names occurs anywhere, so 'american white' has no group.
    """
    text = F.lower(raw)
    return (
        F.when(text.rlike("^white"), "white")
        .when(text.rlike("^black"), "black")
        .when(text.rlike("^(hisp|latin)"), "hispanic")
        .when(text.rlike("^asia"), "asian")
        .when(~text.rlike("white|black|hispanic|asian"), "other")
    )


def encode_ethnicity(df: DataFrame) -> DataFrame:
    return one_hot(df.withColumn("ethnicity", ethnicity_group(F.col("ethnicity"))), "ethnicity", ETHNICITY_GROUPS, "eth")


def encode_demographics(df: DataFrame) -> DataFrame:
    """Gender and ethnicity, each only if present."""
    if "gender" in df.columns:
        df = df.withColumn("gender", gender_flag(F.col("gender")))
    return encode_ethnicity(df) if "ethnicity" in df.columns else df


def encode_dnr(df: DataFrame) -> DataFrame:
    if not {"dnr", "dnr_first_charttime"} <= set(df.columns):
        return df
    window_flag = dnr_flag(F.col("dnr"), F.col("dnr_first_charttime"), F.col("admittime"))
    return df.withColumn("dnr", window_flag).drop("dnr_first_charttime", "dnr_first")


def encode_admission(df: DataFrame) -> DataFrame:
    """Insurance, first care unit and admission type."""
    df = one_hot(df, "insurance", INSURANCE_TYPES, "insurance")
    df = one_hot(df, "first_careunit", FIRST_CARE_UNITS, "first_careunit")
    return one_hot(df, "admission_type", ADMISSION_TYPES, "admission_type")
