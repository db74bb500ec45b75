"""One feature row per stay, from the hourly extract or from raw events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clinspark.config import ADMISSION_DROP, STATIC_DROP, FeatureOptions
from clinspark.functions.encoding import encode_admission, encode_demographics, encode_dnr
from clinspark.operators.cohort import bundle_in_cohort, in_cohort, select_cohort
from clinspark.operators.measurements import (
    FAHRENHEIT_TO_CELSIUS, UnitRule, align_features, clean_measurements, hourly_to_stay, interventions_to_stay,
    known_stays, pivot_measurements, stay_columns, window_events, within_hours, without_errors,
)
from clinspark.operators.scores import ClinicalTables, extend_features
from clinspark.schemas import ICU_KEYS, STAY_KEYS, select_features
from clinspark.session import stage_table
from clinspark.sources.extract import ExtractBundle


def encode_static(df: DataFrame) -> DataFrame:
    """All encodings of the extract, then outcome, leakage and bookkeeping columns dropped."""
    return encode_admission(encode_dnr(encode_demographics(df))).drop(*STATIC_DROP)


@dataclass(frozen=True)
class StayTables:
    """Measurements and interventions per ICU stay inside one window, with the statistics of all options, written once."""

    vitals: DataFrame
    treated: DataFrame
    measured: tuple[str, ...]
    window_hours: int

    def vitals_for(self, extended: bool) -> DataFrame:
        return self.vitals.select(*ICU_KEYS, *[F.col(f"`{c}`") for c in stay_columns(self.measured, extended)])


def aggregate_stays(
    bundle: ExtractBundle, allowed: DataFrame, options: Sequence[FeatureOptions]
) -> dict[int, StayTables]:
    """By window: the stays of the allowed subjects, aggregated once for all ``options`` that use the window.

    The hourly tables are scanned once per window; every outcome projects its statistics from the result.
    """
    wanted = [o for o in options if o.aggregate]
    extended = {hours: any(o.extended for o in wanted if o.window_hours == hours) for hours in {o.window_hours for o in wanted}}
    tables = {}
    for hours, wide in extended.items():
        vitals = in_cohort(hourly_to_stay(within_hours(bundle.hourly, hours), bundle.measured, wide), allowed)
        treated = in_cohort(interventions_to_stay(within_hours(bundle.interventions, hours), bundle.treated), allowed)
        tables[hours] = StayTables(
            stage_table(vitals, "stay-vitals"), stage_table(treated, "stay-interventions"), tuple(bundle.measured), hours)
    return tables


def extract_features(
    bundle: ExtractBundle,
    hosps: DataFrame,
    allowed: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    clinical: ClinicalTables | None = None,
    stays: Mapping[int, StayTables] | None = None,
) -> DataFrame:
    """Features of the selected cohort from the hourly extract: a row per ICU stay, the first of an admission if extended.

    Hour and column filters reach the scan.  Hourly rows are aggregated per stay before they meet the cohort:
    the shuffle then carries stays instead of hours, and a stay with very many rows is combined where it is
    read.  Catalyst still moves the subject test below the aggregation where the cohort can be broadcast.  ``stays`` from
    ``aggregate_stays`` over the same or more subjects stand in for the aggregation.
    """
    if options.extended and clinical is None:
        raise ValueError("extended features need the clinical tables")
    cohort = select_cohort(hosps, allowed, options.cohort)
    if options.aggregate and stays is not None:
        shared = stays[options.window_hours]
        vitals, treated = shared.vitals_for(options.extended), shared.treated
    else:
        vitals, treated = (within_hours(t, options.window_hours) for t in (bundle.hourly, bundle.interventions))
        if options.aggregate:
            vitals = hourly_to_stay(vitals, bundle.measured, options.extended)
            treated = interventions_to_stay(treated, bundle.treated)
    static, vitals, treated = bundle_in_cohort((bundle.static, vitals, treated), cohort)
    features = align_features(static, vitals, treated, not options.aggregate, first_only=options.extended)
    if not options.minimal:
        features = encode_static(features)
    if options.extended:
        features = extend_features(features, clinical)
    return features if options.select is None else select_features(features, options.select)


@dataclass(frozen=True)
class EventTables:
    """Raw measurements and the metadata of the items to use."""

    charts: DataFrame
    labs: DataFrame
    chart_items: DataFrame
    lab_items: DataFrame
    unit_rules: tuple[UnitRule, ...] = (FAHRENHEIT_TO_CELSIUS,)


def event_measurements(
    tables: EventTables, admissions: DataFrame, hosps: DataFrame, allowed: DataFrame, options: FeatureOptions
) -> DataFrame:
    """Cleaned labs and vitals of the cohort inside the window, as one long table.

    Known admissions and the cohort are applied to the admissions, whose rows the window join needs anyway:
    the events pass one large join instead of three.  Items, error marks and valid ranges are tested before it.
    """
    hours, cohort = options.window_hours, select_cohort(hosps, allowed, options.cohort)
    stays = in_cohort(known_stays(admissions, hosps), cohort)

    def load(events: DataFrame, items: DataFrame, drop_errors: bool, rules: tuple[UnitRule, ...]) -> DataFrame:
        usable = without_errors(events) if drop_errors else events
        return window_events(clean_measurements(usable, items, rules), stays, hours=hours)

    columns = [*STAY_KEYS, "charttime", "admittime", "itemid", "feature name", "valuenum"]
    vitals = load(tables.charts, tables.chart_items, True, tables.unit_rules).select(*columns)
    labs = load(tables.labs, tables.lab_items, False, ()).select(*columns)
    return labs.unionByName(vitals)


def event_features(
    tables: EventTables,
    admissions: DataFrame,
    hosps: DataFrame,
    allowed: DataFrame,
    feature_names: Sequence[str],
    options: FeatureOptions = FeatureOptions(),
) -> DataFrame:
    """Features of every stay of the selected subjects from raw events.

    ``feature_names`` are the names after unit conversion and fix the columns of the result.
    """
    cohort = select_cohort(hosps, allowed, options.cohort)
    measurements = event_measurements(tables, admissions, hosps, allowed, options)
    if options.aggregate:
        measurements = pivot_measurements(measurements, feature_names)
    else:
        measurements = measurements.drop("admittime")
    features = in_cohort(hosps, cohort).join(measurements, list(STAY_KEYS), "left")
    if not options.minimal:
        features = encode_demographics(features).drop(*ADMISSION_DROP)
    return features if options.select is None else select_features(features, options.select)
