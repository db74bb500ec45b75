"""The registered queries: every operator bound to the stand-in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from clinspark.catalog import standins as s
from clinspark.catalog.standin_sql import LINEAR_SCORE
from clinspark.config import (
    FINAL_MODELS, READMISSION_FEATURES, SEVERITY_SCORES, CohortOptions, FeatureOptions, Learner, Outcome,
)
from clinspark.functions.encoding import encode_admission, encode_demographics
from clinspark.functions.flags import age_group
from clinspark.operators import attribution, labels, measurements as m, metrics, preparation as prep, sampling
from clinspark.operators.cohort import cohort_funnel, first_stay, in_cohort, select_cohort
from clinspark.operators.ensembles import RiskModel, calibrate, fit_calibrator, mean_probability
from clinspark.operators.scores import aki_by_icustay, aki_by_stay, bmi_flags, merge_severity
from clinspark.plans import features as plans
from clinspark.plans.scoring import outcome_coverage, outer_join_predictions, score_unseen_subjects
from clinspark.plans.training import load_models, train_all, train_model
from clinspark.plans.tuning import grid_search
from clinspark.schemas import STAY_KEYS
from clinspark.session import configure, shared_folder
from clinspark.sources.cache import cached_extract
from clinspark.sources.extract import read_extract
from clinspark.sources.tables import load_base_admissions, load_score_tables, read_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEATURES = ("gender", "age", "qty", "disc", "price", "empty_col", "const_col", "vent")
NUMERICAL = ("age", "qty", "disc", "price", "empty_col", "const_col", "gender")
# The registered training runs have the configured sizes.
FOREST = FINAL_MODELS[Outcome.PROLONGED_STAY].params
BOOSTED = FINAL_MODELS[Outcome.MORTALITY].params


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers as bigint: what the SQL side returns too."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(columns)


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore keeps it apart from the operator it calls."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(fn(configure(spark), sf_dir))

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


# --- sources, cohort, labels ------------------------------------------------------------------


@query
def base_admissions(spark, d):
    return load_base_admissions(*s.admissions_and_patients(spark, d))


@query
def cohort_select(spark, d):
    return select_cohort(s.hosps(spark, d), s.cohort(spark, d))


@query
def cohort_select_no_death(spark, d):
    return select_cohort(s.hosps(spark, d), s.cohort(spark, d), CohortOptions(drop_in_hospital_death=True))


@query
def cohort_select_uncapped(spark, d):
    return select_cohort(s.hosps(spark, d), s.cohort(spark, d), CohortOptions(cap_los=False))


@query
def cohort_funnel_(spark, d):
    return cohort_funnel(s.hosps(spark, d), s.cohort(spark, d), CohortOptions(drop_in_hospital_death=True))



@query
def first_stay_nonnull(spark, d):
    return first_stay(s.hosps(spark, d))


@query
def first_stay_row(spark, d):
    return first_stay(s.hosps(spark, d), "row")


@query
def label_mortality(spark, d):
    return labels.build_target(s.hosps(spark, d), s.cohort(spark, d), Outcome.MORTALITY)


@query
def label_prolonged(spark, d):
    return labels.build_target(s.hosps(spark, d), s.cohort(spark, d), Outcome.PROLONGED_STAY)


@query
def label_readmission(spark, d):
    return labels.build_target(s.hosps(spark, d), s.cohort(spark, d), Outcome.READMISSION)


@query
def mortality_by_age_group(spark, d):
    """Flagship: admissions, cohort, label and age group in one plan."""
    labelled = labels.add_label(s.hosps(spark, d), Outcome.MORTALITY)
    chosen = labels.without_subjects(select_cohort(labelled, s.cohort(spark, d)), labels.OVERLAPPING_STAY_SUBJECTS)
    return chosen.groupBy(age_group(F.col("age")).alias("age_group")).agg(
        F.count("*").alias("n"), F.sum("target").alias("deaths"), F.avg("target").alias("mortality_rate")
    )


@query
def sources_roundtrip(spark, d):
    """Write cohort ids as CSV and the extract through the cache, read both back and restrict."""
    root = f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    s.event_cohort(spark, d).write.option("header", True).csv(f"{root}/cohort")
    for _ in range(2):  # the second call finds the stored tables
        cached_extract(spark, f"{root}/extract", lambda: s.bundle(spark, d))
    bundle = read_extract(spark, f"{root}/extract")
    hourly = bundle.hourly.drop("subject_id", "hadm_id").join(bundle.stay_map, "icustay_id")
    return in_cohort(hourly, read_csv(spark, f"{root}/cohort"))


# --- measurements -----------------------------------------------------------------------------


def _window(spark, d, drop_errors):
    stays = s.event_stays(spark, d)
    events = m.known_stays(s.measurements(spark, d), stays)
    found = m.window_events(events, stays, s.items(spark), drop_errors=drop_errors)
    return found.select("subject_id", "hadm_id", "event_id", "charttime", "itemid", "valuenum", "admittime")


@query
def vitals_window(spark, d):
    return _window(spark, d, True)


@query
def labs_window(spark, d):
    return _window(spark, d, False)


@query
def clean_measurements(spark, d):
    tables = s.event_tables(spark, d)
    vitals = m.clean_measurements(tables.charts, tables.chart_items, tables.unit_rules)
    labs = m.clean_measurements(tables.labs, tables.lab_items)
    columns = ["subject_id", "hadm_id", "event_id", F.col("feature name").alias("feature_name"), "valuenum"]
    return labs.select(columns).unionByName(vitals.select(columns))


@query
def hours_in_violations(spark, d):
    events = s.measurements(spark, d).join(
        s.event_stays(spark, d).select("subject_id", "hadm_id", "admittime"), ["subject_id", "hadm_id"]
    )
    return m.hours_in_violations(events).select("event_id", "hours_in")


@query
def pivot_measurements(spark, d):
    stays, tables = s.event_stays(spark, d), s.event_tables(spark, d)
    columns = ["subject_id", "hadm_id", "feature name", "valuenum"]

    def load(events, items, errors, rules):
        return m.clean_measurements(m.window_events(events, stays, items, drop_errors=errors), items, rules).select(columns)

    vitals = load(tables.charts, tables.chart_items, True, tables.unit_rules)
    labs = load(tables.labs, tables.lab_items, False, ())
    return m.pivot_measurements(labs.unionByName(vitals), s.MEASURED_NAMES)


@query
def hourly_to_stay(spark, d):
    return m.hourly_to_stay(m.within_hours(s.hourly(spark, d)), s.HOURLY_NAMES)


@query
def hourly_to_stay_extended(spark, d):
    return m.hourly_to_stay(m.within_hours(s.hourly(spark, d)), s.HOURLY_NAMES, extended=True)


@query
def hourly_to_stay_long_form(spark, d):
    """The form with a row per cell, on the same columns."""
    return m.unpivoted_to_stay(m.within_hours(s.hourly(spark, d)), s.HOURLY_NAMES, extended=True)


@query
def interventions_max(spark, d):
    return m.interventions_to_stay(m.within_hours(s.interventions(spark, d)), s.TREATED_NAMES)


@query
def align_features(spark, d):
    return m.align_features(
        s.event_stays(spark, d), m.hourly_to_stay(m.within_hours(s.hourly(spark, d)), s.HOURLY_NAMES),
        m.interventions_to_stay(m.within_hours(s.interventions(spark, d)), s.TREATED_NAMES),
    )


# --- encodings and scores ---------------------------------------------------------------------


@query
def encode_ethnicity(spark, d):
    return encode_demographics(s.stays(spark, d).select("subject_id", "hadm_id", "gender", "ethnicity"))


@query
def encode_admission_(spark, d):
    return encode_admission(
        s.stays(spark, d).select("subject_id", "hadm_id", "insurance", "first_careunit", "admission_type")
    )



@query
def encode_static(spark, d):
    return plans.encode_static(s.static_extract(spark, d))


@query
def bmi_flags_(spark, d):
    vitals = m.hourly_to_stay(m.within_hours(s.hourly(spark, d)), ["weight", "height", "hemoglobin"])
    return bmi_flags(vitals).select(*STAY_KEYS, "bmi", "high_level_of_hemoglobin", "underweight", "overweight")



@query
def features_with_target(spark, d):
    hosps = s.hosps(spark, d)
    encoded = encode_demographics(hosps).drop("admittime", "dischtime", "deathtime", "dob", "dod")
    groups = prep.column_groups(encoded.columns)
    target = labels.build_target(hosps, s.cohort(spark, d), Outcome.MORTALITY)
    features = encoded.select(*STAY_KEYS, *groups.numerical, *groups.categorical, *groups.interventions)
    return labels.features_with_target(features, target)


@query
def severity_merge(spark, d):
    return merge_severity(load_score_tables(s.severity(spark, d), "seq"), "seq", (*SEVERITY_SCORES, "meld"))


@query
def aki_42h(spark, d):
    return aki_by_icustay(s.icu_stays(spark, d), s.kdigo(spark, d))


@query
def aki_by_stay_(spark, d):
    tables = s.clinical(spark, d)
    return aki_by_stay(tables.icustays, tables.kdigo, tables.stay_map)



# --- feature composites -----------------------------------------------------------------------


@query
def features_events(spark, d):
    stays = s.event_stays(spark, d)
    return plans.event_features(
        s.event_tables(spark, d), stays, s.event_hosps(spark, d), s.event_cohort(spark, d), s.MEASURED_NAMES
    )


def _extract(spark, d, options):
    study = s.study(spark, d)
    return plans.extract_features(study.bundle, study.hosps, s.event_cohort(spark, d), options, study.clinical)


@query
def features_extract(spark, d):
    return _extract(spark, d, FeatureOptions())


@query
def features_extract_hourly(spark, d):
    return _extract(spark, d, FeatureOptions(aggregate=False))


@query
def features_extract_extended(spark, d):
    return _extract(spark, d, FeatureOptions(extended=True))


def _extract_split(spark, d, options):
    """From an extract in which some admissions have two ICU stays."""
    study = s.study(spark, d)
    return plans.extract_features(s.split_bundle(spark, d), study.hosps, s.event_cohort(spark, d), options, study.clinical)


@query
def features_extract_two_stays(spark, d):
    return _extract_split(spark, d, FeatureOptions())


@query
def features_extract_hourly_two_stays(spark, d):
    return _extract_split(spark, d, FeatureOptions(aggregate=False))


@query
def features_extract_extended_two_stays(spark, d):
    return _extract_split(spark, d, FeatureOptions(extended=True))


@query
def features_extract_selected(spark, d):
    options = FeatureOptions(CohortOptions(drop_in_hospital_death=True), extended=True, select=READMISSION_FEATURES)
    return _extract(spark, d, options)


# --- preparation and sampling -----------------------------------------------------------------


@query
def group_means(spark, d):
    return prep.group_means(s.feature_rows(spark, d), NUMERICAL[1:6])


@query
def impute_group_mean(spark, d):
    rows = s.feature_rows(spark, d)
    return prep.GroupMeans.fit(rows, NUMERICAL).transform(rows)


@query
def impute_median(spark, d):
    rows = s.feature_rows(spark, d)
    return prep.Medians.fit(rows, NUMERICAL).transform(rows)


@query
def impute_median_large(spark, d):
    """The selection used for columns too long for one buffer, forced on the same columns."""
    rows = s.feature_rows(spark, d)
    return prep.Medians.fit(rows, NUMERICAL, piece_rows=500).transform(rows)


@query
def scale(spark, d):
    rows = s.feature_rows(spark, d).drop("vent", "y")
    return prep.Scaling.fit(rows, NUMERICAL).transform(rows)


@query
def prepare(spark, d):
    rows = s.feature_rows(spark, d)
    return prep.Preparation.fit(rows, NUMERICAL, ["vent"]).transform(rows)


@query
def strat_split(spark, d):
    return sampling.stratified_split(s.scored(spark, d), "y", "row_id", seed=7).drop("score")


@query
def strat_folds(spark, d):
    return sampling.stratified_folds(s.scored(spark, d), "y", "row_id").drop("score")


@query
def balanced_sample(spark, d):
    return sampling.balanced_draws(s.scored(spark, d), "y", "row_id", seed=7, bags=3).drop("score")


# --- evaluation -------------------------------------------------------------------------------


@query
def confusion(spark, d):
    return metrics.confusion(s.scored(spark, d))


@query
def metric_report(spark, d):
    return metrics.metric_report(s.scored(spark, d))


@query
def pr_points(spark, d):
    return metrics.pr_points(s.scored(spark, d))


@query
def roc_points(spark, d):
    return metrics.roc_points(s.scored(spark, d))


@query
def calibration_bins(spark, d):
    return metrics.calibration_bins(s.scored(spark, d))


@query
def score_histogram(spark, d):
    return metrics.score_histogram(s.scored(spark, d))


@query
def bootstrap_bands(spark, d):
    return metrics.bootstrap_bands(s.scored(spark, d), "row_id", seed=5)


# --- models -----------------------------------------------------------------------------------


def _train(spark, d, learner, params) -> RiskModel:
    return train_model(s.feature_rows(spark, d), learner, params, label="y", key="row_id", exclude=("row_id", "y"))


@query
def train_score_forest(spark, d):
    """Train, save, load and score."""
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    _train(spark, d, Learner.FOREST, FOREST).save(path)
    return RiskModel.load(path, spark).score(s.feature_rows(spark, d), ["row_id", "y"])


@query
def train_score_boosted(spark, d):
    return _train(spark, d, Learner.BOOSTED, BOOSTED).score(s.feature_rows(spark, d), ["row_id", "y"])


@query
def calibrated_scores(spark, d):
    """Calibration curve of the calibrated probabilities."""
    scored = _train(spark, d, Learner.FOREST, FOREST).score(s.feature_rows(spark, d), ["row_id", "y"])
    return metrics.calibration_bins(scored, score="probability")


@query
def score_all_targets(spark, d):
    """Train the three outcomes on the cohort, save and load them, then score the other subjects."""
    study, cohort = s.study(spark, d), s.event_cohort(spark, d)
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    train_all(study, cohort, save_to=root)
    unseen = study.hosps.select("subject_id").distinct().join(cohort, "subject_id", "left_anti")
    return score_unseen_subjects(study, unseen, load_models(root))


@query
def unseen_coverage(spark, d):
    """Which outcomes each subject outside the cohort gets a score for."""
    study = s.study(spark, d)
    unseen = study.hosps.select("subject_id").distinct().join(s.event_cohort(spark, d), "subject_id", "left_anti")
    return outcome_coverage(study, unseen)


@query
def join_predictions(spark, d):
    """Three prediction tables over different cohorts, with a number made from the subject as probability."""
    hosps, allowed = s.hosps(spark, d), s.cohort(spark, d)
    choices = (CohortOptions(), CohortOptions(cap_los=False), CohortOptions(drop_in_hospital_death=True))
    return outer_join_predictions(
        select_cohort(hosps, allowed, options).select(
            "subject_id", (F.col("subject_id") * factor % 100 / 100).alias(outcome.value)
        )
        for outcome, options, factor in zip(Outcome, choices, (3, 7, 11))
    )


@query
def grid_search_scores(spark, d):
    return grid_search(
        s.feature_rows(spark, d), Learner.FOREST, label="y", key="row_id", exclude=("row_id", "y")
    ).scores


@query
def forest_importance(spark, d):
    return attribution.forest_importance(_train(spark, d, Learner.FOREST, FOREST))


# --- models whose answer is known -------------------------------------------------------------


def _exact_rows(spark, d, label):
    """Columns of few values and a label that follows from them, so that SQL knows what a model must return."""
    return s.feature_rows(spark, d).select("row_id", "age", "gender", "vent", F.expr(label).alias("y"))


def _train_exact(spark, d, learner, params, label) -> RiskModel:
    return train_model(
        _exact_rows(spark, d, label), learner, params, label="y", key="row_id", exclude=("row_id", "y")
    )


@query
def train_score_forest_exact(spark, d):
    """Train, save, load and score."""
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    _train_exact(spark, d, Learner.FOREST, FOREST, "gender * vent").save(path)
    rows = _exact_rows(spark, d, "gender * vent")
    return RiskModel.load(path, spark).score(rows, ["row_id", "y"]).drop("raw_score")


@query
def train_score_boosted_exact(spark, d):
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    _train_exact(spark, d, Learner.BOOSTED, BOOSTED, "gender * vent").save(path)
    rows = _exact_rows(spark, d, "gender * vent")
    return RiskModel.load(path, spark).score(rows, ["row_id", "y"]).drop("raw_score")


@query
def grid_search_exact(spark, d):
    """The default grid on a label that every candidate learns."""
    return grid_search(
        _exact_rows(spark, d, "gender * vent"), Learner.FOREST, label="y", key="row_id", exclude=("row_id", "y")
    ).scores


@query
def forest_importance_exact(spark, d):
    return attribution.forest_importance(
        _train_exact(spark, d, Learner.FOREST, FOREST, "vent")
    )


@query
def isotonic_calibration(spark, d):
    rows = s.scored(spark, d)
    return calibrate(rows.select("row_id", "score"), fit_calibrator(rows, "y", "score"), "score")


@query
def attributions_linear(spark, d):
    """Attributions of a weighted sum."""
    def score(df):
        parts = [F.get("features", F.lit(j)) * float(w) for j, (w, _) in enumerate(LINEAR_SCORE.values())]
        return df.withColumn("raw_score", sum(parts, F.lit(0.0)))

    return attribution.shapley_attributions(
        s.feature_rows(spark, d), "row_id", tuple(LINEAR_SCORE), score, {c: b for c, (_, b) in LINEAR_SCORE.items()}
    )


def _attributions(spark, d):
    rows = s.feature_rows(spark, d)
    model = _train(spark, d, Learner.FOREST, FOREST)
    prepared = model.preparation.transform(rows)
    # Scaled features are centred, so the baseline is the average row.
    return attribution.shapley_attributions(
        prepared, "row_id", model.features, lambda v: mean_probability(v, model.members, deal=False),
        dict.fromkeys(model.features, 0.0),
    )


@query
def attributions(spark, d):
    return _attributions(spark, d)


@query
def top_k_by_attribution(spark, d):
    return attribution.select_by_attribution(
        _train(spark, d, Learner.FOREST, FOREST), s.feature_rows(spark, d), "row_id", k=3
    )


@query
def top_k_features(spark, d):
    """Selection over the absolute standardised values, which SQL can follow."""
    rows, names = s.feature_rows(spark, d), ("qty", "disc", "price", "const_col", "age", "gender")
    scaling = prep.Scaling.fit(rows.withColumn("sex", F.col("gender")), [*names[:5], "sex"])
    scaled = scaling.transform(rows.withColumn("sex", F.col("gender"))).drop("gender").withColumnRenamed("sex", "gender")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 12).alias("attribution")) for c in names])
    return attribution.top_features(scaled.select(F.inline(cells)), k=2)
