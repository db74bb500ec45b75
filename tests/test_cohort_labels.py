import pytest
from pyspark.sql import functions as F

from clinspark.config import CohortOptions, Outcome
from clinspark.functions.temporal import age_at, elapsed_hours
from clinspark.operators.cohort import base_admissions, cohort_funnel, first_stay, in_cohort, select_cohort
from clinspark.operators.labels import add_label, build_target
from conftest import by, hosp_rows, ids, ts


def test_age_and_los(spark):
    rows = spark.createDataFrame(
        [(1, ts("2000-03-02"), ts("2018-03-01")), (2, ts("2000-03-02"), ts("2018-03-02")), (3, ts("2019-01-01"), ts("2018-03-02"))],
        "id int, dob timestamp_ntz, adm timestamp_ntz",
    )
    assert by(rows.select("id", age_at(F.col("adm"), F.col("dob")).alias("a")), "id", "a") == {1: 17, 2: 18, 3: 0}
    early = spark.createDataFrame([(ts("2020-01-01T10:00:00"), ts("2020-01-01T09:30:00"))], "a timestamp_ntz, d timestamp_ntz")
    assert early.select(elapsed_hours(F.col("a"), F.col("d"))).first()[0] == -1


def test_base_admissions_needs_chart_data(spark):
    adm = spark.createDataFrame(
        [(1, 10, ts("2020-01-01"), ts("2020-01-03"), None, "WHITE", 1), (1, 11, ts("2020-02-01"), ts("2020-02-03"), None, "WHITE", 0)],
        "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, ethnicity string, has_chartevents_data int",
    )
    pat = spark.createDataFrame([(1, "M", ts("1950-06-01"), None)], "subject_id bigint, gender string, dob timestamp_ntz, dod timestamp_ntz")
    row = base_admissions(adm, pat).collect()
    assert [(r.hadm_id, r.age, r.los_hosp_hr) for r in row] == [(10, 69, 48.0)]


def test_los_and_age_limits(spark):
    day = "2020-01-01T00:00:00"
    rows = [(i, i, day, day, None, None, age, los) for i, (age, los) in enumerate(
        [(18, 47), (18, 48), (89, 240), (50, 241), (17, 100), (90, 100)])]
    kept = select_cohort(hosp_rows(spark, rows), ids(spark, *range(6)))
    assert {r.subject_id for r in kept.collect()} == {1, 2}
    uncapped = select_cohort(hosp_rows(spark, rows), ids(spark, *range(6)), CohortOptions(cap_los=False))
    assert {r.subject_id for r in uncapped.collect()} == {1, 2, 3}


def test_first_stay_modes(spark):
    rows = [(1, 11, "2020-02-01", "2020-02-05", "2020-02-04", None, 40, 96), (1, 10, "2020-01-01", "2020-01-05", None, None, 40, 96)]
    nonnull, row = first_stay(hosp_rows(spark, rows)).first(), first_stay(hosp_rows(spark, rows), "row").first()
    assert (nonnull.hadm_id, nonnull.deathtime) == (10, ts("2020-02-04"))
    assert (row.hadm_id, row.deathtime) == (10, None)
    with pytest.raises(ValueError):
        first_stay(hosp_rows(spark, rows), "last")


def test_in_hospital_death_and_funnel(spark):
    rows = [
        (1, 1, "2020-01-01", "2020-01-05", "2020-01-04", None, 40, 96), (2, 2, "2020-01-01", "2020-01-05", None, None, 40, 96),
        (3, 3, "2020-01-01", "2020-01-05", None, None, 10, 96), (2, 4, "2021-01-01", "2021-01-05", None, None, 41, 96),
        (9, 9, "2020-01-01", "2020-01-05", None, None, 40, 96),
    ]
    hosps, allowed, options = hosp_rows(spark, rows), ids(spark, 1, 2, 3), CohortOptions(drop_in_hospital_death=True)
    assert [(r.step, r.n) for r in cohort_funnel(hosps, allowed, options).orderBy("step").collect()] == [
        (0, 4), (1, 3), (2, 2), (3, 2), (4, 2), (5, 1)]
    assert [r.subject_id for r in select_cohort(hosps, allowed, options).collect()] == [2]
    assert cohort_funnel(hosps, ids(spark, 77)).agg(F.sum("n")).first()[0] == 0


def test_mortality(spark):
    out = "2020-01-10T15:00:00"
    rows = [
        (1, 1, "2020-01-01", out, None, "2020-01-10", 40, 200), (2, 2, "2020-01-01", out, None, "2020-02-10T14:00:00", 40, 200),
        (3, 3, "2020-01-01", out, None, "2020-02-10T15:00:00", 40, 200), (4, 4, "2020-01-01", out, "2020-01-09", None, 40, 200),
        (5, 5, "2020-01-01", out, None, None, 40, 200),
    ]
    assert by(add_label(hosp_rows(spark, rows), Outcome.MORTALITY), "subject_id", "target") == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_prolonged(spark):
    rows = [(1, 1, "2020-01-01", "2020-01-08", None, None, 40, 168), (2, 2, "2020-01-01", "2020-01-08", None, None, 40, 169)]
    assert by(add_label(hosp_rows(spark, rows), Outcome.PROLONGED_STAY), "subject_id", "target") == {1: 0, 2: 1}


def test_readmission(spark):
    def pair(s, back):
        return [(s, 10 * s, "2020-01-01", "2020-01-05", None, None, 40, 96), (s, 10 * s + 1, back, "2020-04-01", None, None, 40, 96)]

    rows = [(1, 10, "2020-01-01", "2020-01-05", None, None, 40, 96)] + pair(2, "2020-02-04T23:00:00") + pair(3, "2020-02-05") + pair(4, "2020-01-03")
    labelled = by(add_label(hosp_rows(spark, rows), Outcome.READMISSION), "hadm_id", "target")
    assert labelled == {10: 0, 20: 1, 21: None, 30: 0, 31: None, 40: 1, 41: None}


def test_target_excludes_listed_subjects(spark):
    rows = [(1, 1, "2020-01-01", "2020-01-05", None, None, 40, 96), (9896, 2, "2020-01-01", "2020-01-05", None, None, 40, 96)]
    target = build_target(hosp_rows(spark, rows), ids(spark, 1, 9896), Outcome.PROLONGED_STAY)
    assert [r.subject_id for r in target.collect()] == [1]
    with pytest.raises(ValueError):
        build_target(hosp_rows(spark, rows), ids(spark, 1), "death")


def test_cohort_filter_needs_subject(spark):
    with pytest.raises(ValueError, match="subject_id"):
        in_cohort(spark.range(3), ids(spark, 1))
