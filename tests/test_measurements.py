import pytest
from pyspark.sql import functions as F

from clinspark.functions.encoding import encode_ethnicity, one_hot
from clinspark.functions.flags import age_group, dnr_flag
from clinspark.functions.temporal import hour_boundaries
from clinspark.operators import measurements as m
from clinspark.operators.scores import aki_by_icustay, bmi_flags, merge_severity
from clinspark.schemas import ADMISSIONS, conform, nan_to_null, select_features
from clinspark.sources.extract import read_extract_group
from conftest import by, ts

ADM = "2020-01-01T10:00:00"


def events(spark, rows):
    return spark.createDataFrame(
        [(1, 7, i, ts(t), 1, v, e) for i, (t, v, e) in enumerate(rows)],
        "subject_id bigint, hadm_id bigint, event_id bigint, charttime timestamp_ntz, itemid int, valuenum double, error int",
    )


def stays(spark):
    return spark.createDataFrame([(1, 7, ts(ADM))], "subject_id bigint, hadm_id bigint, admittime timestamp_ntz")


def items(spark, name="heart rate"):
    return spark.createDataFrame([(1, name, 10.0, 20.0)], "itemid int, `feature name` string, min double, max double")


def test_window_ends_and_errors(spark):
    rows = [(ADM, 1.0, 0), ("2020-01-03T04:00:00", 1.0, 0), ("2020-01-03T04:00:01", 1.0, 0), ("2020-01-01T09:59:59", 1.0, 0),
            (ADM, 1.0, 1), (ADM, 1.0, None)]
    found = m.window_events(events(spark, rows), stays(spark), items(spark), drop_errors=True)
    assert {r.event_id for r in found.collect()} == {0, 1, 5}
    assert m.hours_in_violations(found).count() == 0


def test_valid_range_and_missing(spark):
    rows = [(ADM, v, 0) for v in (10.0, 20.0, None, float("nan"), 9.9, 20.1)]
    assert {r.event_id for r in m.clean_measurements(events(spark, rows), items(spark)).collect()} == {0, 1}


def test_fahrenheit(spark):
    meta = spark.createDataFrame([(1, "TempF", 10.0, 110.0)], "itemid int, `feature name` string, min double, max double")
    row = m.clean_measurements(events(spark, [(ADM, 98.6, 0)]), meta, [m.FAHRENHEIT_TO_CELSIUS]).first()
    assert row["feature name"] == "TempC" and row.valuenum == pytest.approx(37.0)


def test_hour_boundaries(spark):
    row = spark.createDataFrame([(ts("2020-01-01T00:59:00"), ts("2020-01-02T19:01:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert row.select(hour_boundaries(F.col("a"), F.col("b"))).first()[0] == 43


def test_single_hour_has_no_deviation_but_zero_spread(spark):
    row = spark.createDataFrame([(1, 1, 1, 0, 5.0)], "subject_id int, hadm_id int, icustay_id int, hours_in int, hr double")
    for form in (m.hourly_to_stay, m.unpivoted_to_stay):
        got = form(row, ["hr"], extended=True).first()
        assert (got.hr_std, got.hr_spread, got.hr_mean) == (None, 0.0, 5.0)


def test_wide_and_long_forms_agree_on_empty_stays(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0, None, 2.0), (1, 1, 1, 1, None, 4.0), (2, 2, 2, 0, None, None)],
        "subject_id int, hadm_id int, icustay_id int, hours_in int, a double, b double",
    )
    wide, long = (form(df, ["a", "b"], True) for form in (m.hourly_to_stay, m.unpivoted_to_stay))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, long.select(wide.columns).collect()))


def test_one_schema_at_any_width_and_input_type(spark):
    """104 features of three types give doubles, whatever the width that code generation is limited to."""
    names = {f"f{i}": ("int", "float", "double")[i % 3] for i in range(104)}
    row = spark.range(3).select(
        *[F.lit(1).alias(k) for k in ("subject_id", "hadm_id", "icustay_id")], F.col("id").cast("int").alias("hours_in"),
        *[(F.col("id") + i).cast(t).alias(n) for i, (n, t) in enumerate(names.items())],
    )
    wide = m.hourly_to_stay(row, list(names), extended=True)
    assert {t for c, t in wide.dtypes if c.startswith("f")} == {"double"} and len(wide.columns) == 3 + 5 * 104
    got = wide.first()
    assert all((got[f"f{i}_min"], got[f"f{i}_mean"], got[f"f{i}_max"], got[f"f{i}_std"]) == (i, i + 1, i + 2, 1.0) for i in range(104))
    few = m.hourly_to_stay(row, ["f0", "f1", "f2"], extended=True)
    assert few.schema.fields[3:] == wide.schema.fields[3:18]


def test_aki_without_stages(spark):
    icu = spark.createDataFrame([(1, ts(ADM)), (2, ts(ADM))], "icustay_id bigint, intime timestamp_ntz")
    kdigo = spark.createDataFrame(
        [(1, ts("2020-01-01T11:00:00"), 1.0, None, None, 1.0, 1.0, 1.0), (2, ts("2020-01-01T04:30:00"), 1.0, 3, None, 1.0, 1.0, 1.0),
         (2, ts("2020-01-01T05:00:00"), 1.0, 1, 2, 1.0, 1.0, 1.0), (2, ts("2020-01-03T05:00:00"), 1.0, 3, 3, 1.0, 1.0, 1.0)],
        "icustay_id bigint, charttime timestamp_ntz, creat double, aki_stage_creat int, aki_stage_uo int, uo_rt_6hr double, uo_rt_12hr double, uo_rt_24hr double",
    )
    got = {r.icustay_id: (r.aki_stage_42hr, r.aki_42hr, r.aki_stage_creat) for r in aki_by_icustay(icu, kdigo).collect()}
    assert got == {1: (0, 0, None), 2: (2, 1, 1)}


def test_ethnicity(spark):
    rows = spark.createDataFrame(
        [(1, "American White"), (2, "Portuguese"), (3, "Hispanic/Latino - Cuban"), (4, None), (5, "LATIN"), (6, "White - X")], "id int, ethnicity string"
    )
    names = ("asian", "black", "hispanic", "other", "white")
    got = {r.id: [n for n in names if r[f"eth_{n}"]] for r in encode_ethnicity(rows).collect()}
    assert got == {1: [], 2: ["other"], 3: ["hispanic"], 4: [], 5: ["hispanic"], 6: ["white"]}


def test_one_hot_has_fixed_columns(spark):
    assert one_hot(spark.createDataFrame([("x",)], "c string"), "c", ["a", "b"], "c").columns == ["c_a", "c_b"]


def test_bmi(spark):
    rows = spark.createDataFrame(
        [(1, 80.0, 0.0, 13.0), (2, 80.0, 2.0, 12.0), (3, 80.0, None, None), (4, 50.0, 200.0, 1.0)],
        "id int, weight_mean double, height_mean double, hemoglobin_mean double",
    )
    got = {r.id: (r.bmi, r.underweight, r.overweight, r.high_level_of_hemoglobin) for r in bmi_flags(rows).collect()}
    assert got == {1: (None, 0, 0, 1), 2: (300.0, 0, 1, 0), 3: (None, 0, 0, 0), 4: (12.5, 1, 0, 0)}


def test_dnr(spark):
    rows = spark.createDataFrame(
        [(1, 1, ts(ADM), ts("2020-01-03T04:59:00")), (2, 1, ts(ADM), ts("2020-01-03T05:00:00")), (3, 1, ts(ADM), None),
         (4, 0, ts(ADM), ts(ADM)), (5, None, ts(ADM), ts(ADM)), (6, 1, ts(ADM), ts("2019-12-31T05:00:00"))],
        "id int, dnr int, adm timestamp_ntz, t timestamp_ntz",
    )
    flags = rows.select("id", dnr_flag(F.col("dnr"), F.col("t"), F.col("adm")).alias("f"))
    assert by(flags, "id", "f") == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_age_groups(spark):
    rows = spark.createDataFrame([(a,) for a in (17, 18, 30, 45, 89, 200)], "age int")
    assert [r[0] for r in rows.select(age_group(F.col("age"))).collect()] == [None, "18_29", "30_39", "40_41", "80p", None]


def test_repeated_scores_do_not_multiply(spark):
    one = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 1, 9)], "subject_id bigint, hadm_id bigint, seq int, v int")
    tables = {n: one.withColumnRenamed("v", n) for n in ("sirs", "sapsii", "apsiii", "sofa", "lods", "oasis")}
    row = merge_severity(tables, "seq").collect()
    assert len(row) == 1 and row[0].sofa == 5
    with pytest.raises(ValueError):
        merge_severity({"sirs": one}, "seq")


def test_schema_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="hadm_id"):
        conform(spark.createDataFrame([(1,)], "subject_id bigint"), ADMISSIONS, "admissions")
    with pytest.raises(ValueError, match="nope"):
        select_features(spark.createDataFrame([(1, 2, 3)], "subject_id int, hadm_id int, x int"), ["nope"])
    with pytest.raises(ValueError, match="group"):
        read_extract_group(spark, str(tmp_path), "vitals_labs")
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None
