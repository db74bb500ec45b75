"""Severity scores, acute kidney injury and the derived clinical features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.config import SEVERITY_SCORES, WINDOW_HOURS
from clinspark.functions.flags import bmi, flag
from clinspark.functions.temporal import hour_boundaries
from clinspark.operators.measurements import one_per_key
from clinspark.schemas import STAY_KEYS, require_columns

_PRE_ADMISSION_HOURS = -6


def merge_severity(tables: Mapping[str, DataFrame], order: str, scores: Sequence[str] = SEVERITY_SCORES) -> DataFrame:
    """One row per stay present in the tables of all ``scores``, with the first value of each by ``order``.

    The stacked tables are aggregated once, so all scores share one exchange and no product of repeats is built: the
    same result as the first row of that product.  Rows are dealt by key before they are combined: a stay has few rows in
    a table, and a task that reads many stays would sort all of them only to combine those few.  The number of parts is
    that of the session and parts are not coalesced, so that what a task sorts stays small.
    """
    missing = [s for s in scores if s not in tables]
    if missing:
        raise ValueError(f"missing severity tables {missing}")
    for name in scores:
        require_columns(tables[name], [*STAY_KEYS, name], name)
    stacked = reduce(
        lambda up, down: up.unionByName(down, allowMissingColumns=True),
        [tables[s].select(*STAY_KEYS, F.col(order).alias("_order"), F.lit(no).alias("_score"), s) for no, s in enumerate(scores)],
    )
    # A struct also marks a stay whose first value is missing; a stay without rows in a table gets no struct.
    first = [
        F.min_by(F.struct(s), F.when(F.col("_score") == no, F.struct("_order", s))).alias(s) for no, s in enumerate(scores)
    ]
    # A missing key matches no other table's rows.
    keyed = stacked.where(F.col(STAY_KEYS[0]).isNotNull() & F.col(STAY_KEYS[1]).isNotNull())
    parts = int(stacked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = keyed.repartition(parts, *STAY_KEYS).groupBy(*STAY_KEYS).agg(*first)
    complete = firsts.where(reduce(lambda x, y: x & y, [F.col(s).isNotNull() for s in scores]))
    return complete.select(*STAY_KEYS, *[F.col(f"{s}.{s}").alias(s) for s in scores])


def aki_by_icustay(icustays: DataFrame, kdigo: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """Worst creatinine and urine-output stage per ICU stay from -6 (exclusive) to ``hours`` hour marks.

    Both worst rows come from one join and one aggregation; ``max_by`` over a struct puts missing parts last,
    equal rows are decided by the earliest chart time.
    """
    crossed = hour_boundaries(F.col("intime"), F.col("charttime"))
    charted = kdigo.join(icustays.select("icustay_id", "intime"), "icustay_id").where(
        (crossed > _PRE_ADMISSION_HOURS) & (crossed <= hours)
    )
    earliest = -F.unix_micros(F.col("charttime").cast("timestamp_ltz"))

    def worst(columns: list[str], stage: str, order: list[str]) -> Column:
        rank = F.struct(*[F.col(c) for c in order], earliest)
        return F.max_by(F.struct("charttime", *columns), F.when(F.col(stage).isNotNull(), rank))

    rates = ["uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr"]
    reduced = charted.groupBy("icustay_id").agg(
        worst(["creat", "aki_stage_creat"], "aki_stage_creat", ["aki_stage_creat", "creat"]).alias("_cr"),
        worst([*rates, "aki_stage_uo"], "aki_stage_uo", ["aki_stage_uo", *reversed(rates)]).alias("_uo"),
    )
    creat_stage, urine_stage = F.col("_cr.aki_stage_creat"), F.col("_uo.aki_stage_uo")
    return icustays.select("icustay_id").join(reduced, "icustay_id", "left").select(
        "icustay_id",
        F.col("_cr.charttime").alias("charttime_creat"),
        F.col("_cr.creat").alias("creat"),
        creat_stage.alias("aki_stage_creat"),
        F.col("_uo.charttime").alias("charttime_uo"),
        *[F.col(f"_uo.{r}").alias(r) for r in rates],
        urine_stage.alias("aki_stage_uo"),
        F.greatest(F.coalesce(creat_stage, F.lit(0)), F.coalesce(urine_stage, F.lit(0))).alias("aki_stage_42hr"),
        F.when((creat_stage > 0) | (urine_stage > 0), 1).otherwise(0).alias("aki_42hr"),
    )


def aki_by_stay(icustays: DataFrame, kdigo: DataFrame, stay_map: DataFrame) -> DataFrame:
    """The AKI flag re-keyed to (subject_id, hadm_id), the lowest ICU stay id of each."""
    keyed = aki_by_icustay(icustays, kdigo).select("icustay_id", "aki_42hr").join(stay_map, "icustay_id")
    return one_per_key(keyed.select(*STAY_KEYS, "icustay_id", "aki_42hr"), STAY_KEYS, ["icustay_id"]).drop("icustay_id")


@dataclass(frozen=True)
class ClinicalTables:
    """Inputs of the extended features; ``order`` breaks ties among repeated score rows."""

    severity: Mapping[str, DataFrame]
    meld: DataFrame
    icustays: DataFrame
    kdigo: DataFrame
    stay_map: DataFrame
    order: str


def bmi_flags(df: DataFrame) -> DataFrame:
    """BMI with its two flags and the haemoglobin flag, from the stay means."""
    with_bmi = df.withColumn("bmi", bmi(F.col("weight_mean"), F.col("height_mean")))
    return with_bmi.withColumns(
        {
            "high_level_of_hemoglobin": flag(F.col("hemoglobin_mean") > 12),
            "underweight": flag(F.col("bmi") < 18),
            "overweight": flag(F.col("bmi") > 25),
        }
    )


def extend_features(df: DataFrame, tables: ClinicalTables) -> DataFrame:
    """Severity scores, BMI, MELD, clinical flags and AKI; stays without scores are left out."""
    keys = list(STAY_KEYS)
    scores = merge_severity({**tables.severity, "meld": tables.meld}, tables.order, (*SEVERITY_SCORES, "meld"))
    scored = df.join(scores, keys)
    urgent = (F.col("admission_type_EMERGENCY") == 1) | (F.col("admission_type_URGENT") == 1)
    flagged = bmi_flags(scored).withColumn("emergency_or_urgent_admission", flag(urgent))
    return flagged.join(aki_by_stay(tables.icustays, tables.kdigo, tables.stay_map), keys, "left")
