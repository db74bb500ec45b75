import json

import pytest

from clinspark.operators.preparation import GroupMeans, Medians, Preparation, Scaling, column_groups
from clinspark.schemas import nan_to_null

SCHEMA = "id int, age int, gender int, x double, empty double, const double"
ROWS = [(1, 20, 1, 1.0, None, 3.0), (2, 25, 1, None, None, 3.0), (3, 20, 1, 5.0, None, 3.0), (4, 85, 0, None, None, 3.0),
        (5, None, 0, None, None, 3.0), (6, 45, 0, 100.0, None, 3.0)]
NAMES = ("age", "gender", "x", "empty", "const")


def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_group_mean_then_median(spark):
    filled = GroupMeans.fit(rows(spark), NAMES).transform(rows(spark))
    got = {r.id: r.x for r in filled.collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 5.0, 4: None, 5: None, 6: 100.0}
    medians = Medians.fit(filled, NAMES)
    assert medians.values["x"] == 4.0 and medians.values["empty"] == 0.0
    done = {r.id: r.x for r in medians.transform(filled).collect()}
    assert done == {1: 1.0, 2: 3.0, 3: 5.0, 4: 4.0, 5: 4.0, 6: 100.0}


def test_needs_age_and_gender(spark):
    with pytest.raises(ValueError, match="age"):
        GroupMeans.fit(rows(spark).drop("age"), ["x"])


def test_no_column_to_fill_by_group(spark):
    """Age and gender alone have no group mean; the medians still fill them."""
    prep = Preparation.fit(rows(spark), ["age"], [])
    assert prep.group_means.columns == () and prep.medians.values["age"] == 25.0
    assert prep.transform(rows(spark)).where("age IS NULL OR gender IS NULL").count() == 0


def test_constant_column_divides_by_one(spark):
    scaling = Scaling.fit(rows(spark), ["const", "gender"])
    new = spark.createDataFrame([(5.0, 1)], "const double, gender int")
    row = scaling.transform(new).first()
    assert (row.const, row.gender) == (2.0, 1)


def test_prepared_matrix(spark):
    prep = Preparation.fit(rows(spark), ["age", "x", "empty", "const"], [])
    out = prep.transform(rows(spark))
    assert out.columns == ["id", "age", "x", "empty", "const", "gender"]
    collected = out.collect()
    assert all(v is not None for r in collected for v in r)
    for name in ("age", "x"):
        values = [r[name] for r in collected]
        assert sum(values) == pytest.approx(0, abs=1e-9)
        assert sum(v * v for v in values) / len(values) == pytest.approx(1)
    again = Preparation.from_json(json.loads(json.dumps(prep.to_json())))
    assert again == prep


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 20, 1, float("nan")), (2, 20, 1, 4.0)], "id int, age int, gender int, x double")
    assert {r.x for r in GroupMeans.fit(nan_to_null(df), ["x"]).transform(nan_to_null(df)).collect()} == {4.0}


def test_column_groups():
    groups = column_groups(["subject_id", "hadm_id", "target", "age", "gender", "vent", "hr_mean"])
    assert groups.numerical == ("age", "hr_mean") and groups.categorical == ("gender",) and groups.interventions == ("vent",)
