"""Time-stamped measurements: window join, cleaning, and one row per stay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.config import WINDOW_HOURS
from clinspark.functions.temporal import elapsed_hours
from clinspark.schemas import ICU_KEYS, STAY_KEYS


@dataclass(frozen=True)
class UnitRule:
    """``new = (old - offset) / divisor`` and the feature is renamed."""

    feature: str
    renamed: str
    offset: float
    divisor: float


FAHRENHEIT_TO_CELSIUS = UnitRule("TempF", "TempC", 32.0, 1.8)


def window_events(
    events: DataFrame,
    admissions: DataFrame,
    items: DataFrame | None = None,
    hours: int = WINDOW_HOURS,
    drop_errors: bool = False,
) -> DataFrame:
    """Events of the listed items (all, if none are listed) from admission to ``hours`` later, ends included.

    The item semi join and the error test run before the shuffle.  The time range is a residual condition
    of an equi join, so a stay with very many events is split by AQE instead of filling one task.
    """
    listed = without_errors(events) if drop_errors else events
    if items is not None:
        listed = listed.join(items.select("itemid"), "itemid", "left_semi")
    stays = admissions.select("subject_id", "hadm_id", "admittime")
    limit = F.col("admittime") + F.make_dt_interval(hours=F.lit(hours))
    return listed.join(stays, ["subject_id", "hadm_id"]).where(F.col("charttime").between(F.col("admittime"), limit))


def without_errors(events: DataFrame) -> DataFrame:
    """Rows not marked as an error; an unknown mark is kept."""
    return events.where(~F.col("error").eqNullSafe(F.lit(1)))


def known_stays(df: DataFrame, hosps: DataFrame) -> DataFrame:
    """Rows (events or stays) whose admission is in the admissions table."""
    return df.join(hosps.select("hadm_id"), "hadm_id", "left_semi")


def clean_measurements(events: DataFrame, metadata: DataFrame, rules: Sequence[UnitRule] = ()) -> DataFrame:
    """Attach the feature name, keep values inside the item's valid range, convert units."""
    valued = events.join(metadata, "itemid").where(F.col("valuenum").between(F.col("min"), F.col("max")))
    return convert_units(valued.drop("min", "max"), rules)


def convert_units(df: DataFrame, rules: Sequence[UnitRule]) -> DataFrame:
    name, value = F.col("`feature name`"), F.col("valuenum")
    new_name, new_value = name, value
    for rule in rules:
        hit = name == rule.feature
        new_value = F.when(hit, (value - rule.offset) / rule.divisor).otherwise(new_value)
        new_name = F.when(hit, F.lit(rule.renamed)).otherwise(new_name)
    return df.withColumns({"valuenum": new_value, "feature name": new_name})


def with_hours_in(events: DataFrame) -> DataFrame:
    return events.withColumn("hours_in", elapsed_hours(F.col("admittime"), F.col("charttime")).cast("int"))


def hours_in_violations(events: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """Rows that break the promise of the window join: an empty result means the check holds."""
    return with_hours_in(events).where(F.col("hours_in") > hours)


def pivot_measurements(
    events: DataFrame, features: Sequence[str], keys: Sequence[str] = STAY_KEYS
) -> DataFrame:
    """Long measurements to one row per key with ``min_``, ``max_`` and ``mean_`` of each listed feature."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg}
    pivoted = (
        events.groupBy(*keys)
        .pivot("feature name", list(features))
        .agg(*[f("valuenum").alias(name) for name, f in stats.items()])
    )
    return pivoted.select(
        *keys,
        *[F.col(f"`{feature}_{stat}`").alias(f"{stat}_{feature}") for stat in stats for feature in features],
    )


def within_hours(df: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    return df.where(F.col("hours_in") <= hours)


def _stay_stats(extended: bool) -> dict[str, object]:
    stats = {"mean": F.avg, "min": F.min, "max": F.max}
    if extended:
        stats["std"] = F.stddev_samp
        stats["spread"] = lambda c: F.max(c) - F.min(c)
    return stats


def stay_columns(features: Sequence[str], extended: bool = False) -> list[str]:
    """The columns that ``hourly_to_stay`` makes of the features."""
    return [f"{c}_{stat}" for c in features for stat in _stay_stats(extended)]


def hourly_to_stay(
    hourly: DataFrame, features: Sequence[str], extended: bool = False, keys: Sequence[str] = ICU_KEYS
) -> DataFrame:
    """Hourly values to ``{feature}_{stat}`` per stay: mean, min, max, and with ``extended`` std and spread.

    All columns are aggregated side by side as doubles: an hour stays one row up to the map-side combine, and the types
    of the result depend neither on the number of features nor on a session setting.
    """
    return hourly.groupBy(*keys).agg(*[
        f(F.col(f"`{c}`").cast("double")).alias(f"{c}_{stat}")
        for c in features for stat, f in _stay_stats(extended).items()
    ])


def unpivoted_to_stay(
    hourly: DataFrame, features: Sequence[str], extended: bool = False, keys: Sequence[str] = ICU_KEYS
) -> DataFrame:
    """The rows of ``hourly_to_stay``, aggregated per (stay, feature) and pivoted back.

    Its buffers stay narrow at the cost of a row per cell; a caller chooses it, nothing switches to it.
    """
    stats = _stay_stats(extended)
    # Rows that only hold missing values keep their stay in the result, as in the side-by-side form.
    cells = F.array(*[F.struct(F.lit(c).alias("_f"), F.col(f"`{c}`").cast("double").alias("_v")) for c in features])
    long = hourly.select(*keys, F.inline(cells))
    narrow = long.groupBy(*keys, "_f").agg(*[f(F.col("_v")).alias(stat) for stat, f in stats.items()])
    pivoted = narrow.groupBy(*keys).pivot("_f", list(features)).agg(*[F.first(s).alias(s) for s in stats])
    return pivoted.select(*keys, *[F.col(f"`{c}_{s}`") for c in features for s in stats])


def interventions_to_stay(hourly: DataFrame, columns: Sequence[str], keys: Sequence[str] = ICU_KEYS) -> DataFrame:
    """Whether each intervention happened at all in the window."""
    return hourly.groupBy(*keys).agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in columns])


def align_features(
    static: DataFrame, vitals: DataFrame, interventions: DataFrame, hourly: bool = False, first_only: bool = False
) -> DataFrame:
    """Left joins on the ICU stay, whose id is dropped afterwards; hourly interventions also match the hour.

    An admission with several ICU stays keeps the rows of each, so nothing is lost and no stay meets the values of
    another; with ``first_only`` it keeps those of its lowest ICU stay id.
    """
    keys = list(ICU_KEYS)
    if first_only:
        static = one_per_key(static, STAY_KEYS, ["icustay_id"])
    aligned = static.join(vitals, keys, "left").join(interventions, keys + (["hours_in"] if hourly else []), "left")
    return aligned.drop("icustay_id")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key under an explicit order, combined on the map side."""
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(f"`{o}`") if isinstance(o, str) else o for o in order])
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), rank).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.`{c}`") for c in names])
