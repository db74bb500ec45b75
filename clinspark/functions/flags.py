"""0/1 flags and derived clinical numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clinspark.config import AGE_GROUPS, WINDOW_HOURS
from clinspark.functions.temporal import elapsed_hours


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def gender_flag(gender: Column) -> Column:
    return flag(gender == "M")


def dnr_flag(dnr: Column, first_charted: Column, admitted: Column, hours: int = WINDOW_HOURS) -> Column:
    """Do-not-resuscitate order known inside the prediction window."""
    return flag((elapsed_hours(admitted, first_charted) <= hours) & (dnr != 0))


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Body mass index limited to [10, 300]; a zero height leaves it unknown."""
    metres = height_cm / F.lit(100.0)
    raw = F.try_divide(weight_kg, metres * metres)
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(10.0)), F.lit(300.0)))


def age_group(age: Column) -> Column:
    """Label of the age bracket, NULL outside all of them."""
    (low, high, label), *rest = AGE_GROUPS
    chain = F.when((age >= low) & (age < high), label)
    for low, high, label in rest:
        chain = chain.when((age >= low) & (age < high), label)
    return chain
