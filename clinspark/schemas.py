"""Declared input tables, checks on entry and the NaN rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_LONG, _INT, _DBL, _STR, _TS = LongType(), IntegerType(), DoubleType(), StringType(), TimestampNTZType()


def _struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


ADMISSIONS = _struct(
    subject_id=_LONG, hadm_id=_LONG, admittime=_TS, dischtime=_TS, deathtime=_TS, ethnicity=_STR,
    has_chartevents_data=_INT,
)
PATIENTS = _struct(subject_id=_LONG, gender=_STR, dob=_TS, dod=_TS)
COHORT = _struct(subject_id=_LONG)
CHART_EVENTS = _struct(subject_id=_LONG, hadm_id=_LONG, charttime=_TS, itemid=_INT, valuenum=_DBL, error=_INT)
LAB_EVENTS = _struct(subject_id=_LONG, hadm_id=_LONG, charttime=_TS, itemid=_INT, valuenum=_DBL)
ITEM_METADATA = StructType(
    [StructField("itemid", _INT), StructField("feature name", _STR), StructField("min", _DBL), StructField("max", _DBL)]
)
ICU_STAYS = _struct(icustay_id=_LONG, intime=_TS)
KDIGO_STAGES = _struct(
    icustay_id=_LONG, charttime=_TS, creat=_DBL, uo_rt_6hr=_DBL, uo_rt_12hr=_DBL, uo_rt_24hr=_DBL,
    aki_stage_creat=_INT, aki_stage_uo=_INT,
)

STAY_KEYS = ("subject_id", "hadm_id")
ICU_KEYS = ("subject_id", "hadm_id", "icustay_id")

_FAMILIES = (
    {"tinyint", "smallint", "int", "bigint"},
    {"float", "double"},
    {"string"},
    {"timestamp", "timestamp_ntz"},
)


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}")
    return df


def conform(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """Check that the declared columns are present with a type of the same family, then cast and select them."""
    require_columns(df, schema.names, table)
    found = dict(df.dtypes)
    for wanted in schema:
        have, want = found[wanted.name], wanted.dataType.simpleString()
        if have != want and not any(have in family and want in family for family in _FAMILIES):
            raise TypeError(f"{table}.{wanted.name} is {have}, expected {want}")
    return nan_to_null(df.select([F.col(f"`{s.name}`").cast(s.dataType).alias(s.name) for s in schema]))


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing numbers are NULL throughout; NaN would win every comparison and poison every mean."""
    chosen = None if columns is None else set(columns)
    return df.select(
        [
            F.when(~F.isnan(F.col(f"`{s.name}`")), F.col(f"`{s.name}`")).alias(s.name)
            if isinstance(s.dataType, (DoubleType, FloatType)) and (chosen is None or s.name in chosen)
            else F.col(f"`{s.name}`")
            for s in df.schema
        ]
    )


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def select_features(df: DataFrame, names: Iterable[str], keys: Iterable[str] = STAY_KEYS) -> DataFrame:
    """Keys plus a named feature subset; an unknown name is an error."""
    names, keys = list(names), list(keys)
    require_columns(df, keys + names, "feature matrix")
    return df.select([F.col(f"`{n}`") for n in keys + names])
