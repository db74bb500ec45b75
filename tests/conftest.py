import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clinspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def ts(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)


HOSP_SCHEMA = (
    "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, "
    "dod timestamp_ntz, age int, los_hosp_hr double"
)


def hosp_rows(spark, rows):
    """(subject, hadm, admit, discharge, death, dod, age, los) with times as ISO text."""
    return spark.createDataFrame([(s, h, ts(a), ts(d), ts(x), ts(o), g, float(l)) for s, h, a, d, x, o, g, l in rows], HOSP_SCHEMA)


def ids(spark, *subjects):
    return spark.createDataFrame([(s,) for s in subjects], "subject_id bigint")


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
