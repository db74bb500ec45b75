import pytest
from pyspark.sql import functions as F

from clinspark.catalog import standins as s
from clinspark.config import (
    CATEGORICAL_FEATURES, DEFAULT_GRIDS, FINAL_MODELS, INTERVENTIONS, READMISSION_FEATURES, CohortOptions, FeatureOptions,
    Learner, Outcome,
)
from clinspark.operators.preparation import column_groups
from clinspark.plans.features import event_features, extract_features
from clinspark.plans.training import model_path, training_table
from clinspark.plans.tuning import expand_grid
from clinspark.schemas import ITEM_METADATA, lower_names
from clinspark.session import RUNTIME_SETTINGS, configure, shared_folder
from clinspark.sources.cache import read_or_build, table_written
from clinspark.sources.extract import read_extract
from clinspark.sources.tables import cohort_from_ids, load_base_admissions, read_csv


@pytest.fixture(scope="module")
def study(spark, small_dir):
    return s.study(spark, small_dir)


def test_cache_reads_builds_and_refreshes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"a": spark.range(len(calls)), "b": spark.range(2)}

    path = str(tmp_path / "cache")
    assert read_or_build(spark, path, ["a", "b"], build)["a"].count() == 1
    assert read_or_build(spark, path, ["a", "b"], build)["a"].count() == 1 and len(calls) == 1
    assert read_or_build(spark, path, ["a", "b"], build, refresh=True)["a"].count() == 2
    assert table_written(spark, f"{path}/a") and not table_written(spark, f"{path}/c")
    spark.range(1).write.parquet(str(tmp_path / "part" / "a"))
    read_or_build(spark, str(tmp_path / "part"), ["a", "b"], build)
    assert len(calls) == 3


def test_csv_with_declared_schema(spark, tmp_path):
    s.items(spark).write.option("header", True).csv(str(tmp_path / "meta"))
    back = read_csv(spark, str(tmp_path / "meta"), ITEM_METADATA)
    assert back.schema.names == ["itemid", "feature name", "min", "max"]
    assert sorted(map(tuple, back.collect())) == sorted(s.ITEMS)


def test_extract_bundle_round_trip(spark, small_dir, tmp_path):
    for name, table in s.bundle(spark, small_dir).tables().items():
        table.write.parquet(f"{tmp_path}/{name}")
    bundle = read_extract(spark, str(tmp_path))
    assert bundle.measured == list(s.HOURLY_NAMES) and bundle.treated == list(s.TREATED_NAMES)
    assert bundle.stay_map.count() == bundle.static.count()


def test_cohort_from_ids(spark):
    assert [r.subject_id for r in cohort_from_ids(spark, [3, 1]).collect()] == [3, 1]
    table = spark.createDataFrame([(3, "x")], "subject_id int, note string")
    assert cohort_from_ids(spark, table).schema.simpleString() == "struct<subject_id:bigint>"


def test_names_are_lowered_before_the_check(spark, small_dir):
    admissions, patients = s.admissions_and_patients(spark, small_dir)
    upper = admissions.toDF(*[c.upper() for c in admissions.columns])
    assert load_base_admissions(upper, patients).columns == load_base_admissions(admissions, patients).columns
    assert lower_names(upper).columns == admissions.columns


def test_wrong_type_is_named(spark, small_dir):
    admissions, patients = s.admissions_and_patients(spark, small_dir)
    with pytest.raises(TypeError, match="admissions.hadm_id"):
        load_base_admissions(admissions.withColumn("hadm_id", F.lit("x")), patients)


def test_minimal_keeps_raw_columns(spark, small_dir, study):
    features = extract_features(study.bundle, study.hosps, s.event_cohort(spark, small_dir), FeatureOptions(minimal=True))
    assert {"ethnicity", "insurance", "dischtime", "heart_rate_mean", "vent"} <= set(features.columns)


def test_one_row_per_stay_and_only_numbers(spark, small_dir, study):
    features = extract_features(
        study.bundle, study.hosps, s.event_cohort(spark, small_dir), FeatureOptions(extended=True), study.clinical
    )
    keys = features.select("subject_id", "hadm_id")
    assert keys.count() == keys.distinct().count() > 0
    assert {t for c, t in features.dtypes} <= {"int", "bigint", "double"}


def test_each_icu_stay_keeps_its_own_values(spark, small_dir, study):
    """Two ICU stays of an admission give two rows, each with its own values; the extended form keeps the first."""
    bundle = study.bundle
    moved = lambda t: t.withColumn("icustay_id", F.col("icustay_id") + 1_000_000)
    warmer = moved(bundle.hourly).withColumn("heart_rate", F.col("heart_rate") + 1000)
    doubled = type(bundle)(
        bundle.static.unionByName(moved(bundle.static)), bundle.hourly.unionByName(warmer),
        bundle.interventions.unionByName(moved(bundle.interventions)),
    )
    allowed = s.event_cohort(spark, small_dir)

    def rows(of, **options):
        return sorted(map(tuple, extract_features(of, study.hosps, allowed, FeatureOptions(**options), study.clinical).collect()), key=str)

    assert rows(bundle, extended=True) == rows(doubled, extended=True)
    one, two = rows(bundle), extract_features(doubled, study.hosps, allowed, FeatureOptions()).collect()
    assert len(two) == 2 * len(one)
    first = [r for r in two if r.heart_rate_mean is not None and r.heart_rate_mean < 1000]
    second = [r for r in two if r.heart_rate_mean is not None and r.heart_rate_mean >= 1000]
    shifted = {(r.hadm_id, round(r.heart_rate_mean + 1000, 6)) for r in first}
    assert shifted and shifted == {(r.hadm_id, round(r.heart_rate_mean, 6)) for r in second}
    assert len(rows(doubled, aggregate=False)) == 2 * len(rows(bundle, aggregate=False))


def test_options_and_missing_names(spark, small_dir, study):
    allowed = s.event_cohort(spark, small_dir)
    with pytest.raises(ValueError, match="clinical"):
        extract_features(study.bundle, study.hosps, allowed, FeatureOptions(extended=True))
    with pytest.raises(ValueError, match="meld"):
        extract_features(study.bundle, study.hosps, allowed, FeatureOptions(select=("age", "meld")))
    with pytest.raises(ValueError):
        FeatureOptions(extended=True, aggregate=False)


def test_event_features_keep_every_stay_of_a_subject(spark, small_dir, study):
    features = event_features(
        s.event_tables(spark, small_dir), s.event_stays(spark, small_dir), study.hosps, s.event_cohort(spark, small_dir), s.MEASURED_NAMES
    )
    per_subject = {r["count"] for r in features.groupBy("subject_id").count().collect()}
    assert per_subject == {3}
    assert "min_heart rate" in features.columns and "dob" not in features.columns


def test_training_table_is_the_inner_alignment(spark, small_dir, study):
    table = training_table(study, s.event_cohort(spark, small_dir), FINAL_MODELS[Outcome.MORTALITY])
    assert "target" in table.columns and table.where("target IS NULL").count() == 0
    assert table.count() == table.select("subject_id").distinct().count()


def test_final_configurations():
    assert {o.value for o in FINAL_MODELS} == {"mortality_proba", "prolonged_LOS_proba", "readmission_proba"}
    paths = {model_path("/m/", o) for o in FINAL_MODELS}
    assert len(paths) == 3
    assert FINAL_MODELS[Outcome.READMISSION].features.select == READMISSION_FEATURES
    assert FINAL_MODELS[Outcome.READMISSION].features.cohort == CohortOptions(drop_in_hospital_death=True)
    assert len(expand_grid(DEFAULT_GRIDS[Learner.FOREST])) == 16 and len(expand_grid(DEFAULT_GRIDS[Learner.BOOSTED])) == 12
    assert len(INTERVENTIONS) == 14 and len(CATEGORICAL_FEATURES) == 25


def test_extended_features_group_by_the_fixed_lists(spark, small_dir, study):
    features = extract_features(
        study.bundle, study.hosps, s.event_cohort(spark, small_dir), FeatureOptions(extended=True), study.clinical
    )
    groups = column_groups(features.columns)
    assert set(groups.categorical) == set(CATEGORICAL_FEATURES) and set(groups.interventions) == {"vent", "vaso"}


def test_session_settings(spark):
    configure(spark)
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_SETTINGS.items())
    assert shared_folder(spark) == shared_folder(spark)
