"""Clinical tables derived from the given ones (orders, customer, events, …) by Spark.

Each function returns one clinical-looking table whose size follows the source table.  The same definitions
as SQL text are in ``standin_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from clinspark.config import SEVERITY_SCORES
from clinspark.operators.cohort import base_admissions
from clinspark.operators.scores import ClinicalTables
from clinspark.plans.features import EventTables
from clinspark.plans.training import StudyData
from clinspark.session import stage_table
from clinspark.sources.extract import ExtractBundle


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is inferred on the first read only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _pick(index: Column, values: list[str]) -> Column:
    """The value at a 0-based position, NULL past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``adm``: one admission per order, a subject per customer.

    First and last stay of a subject come from one aggregate, not from a window over all of its stays.
    """
    orders, ends = _timed_orders(spark, sf_dir), _subject_ends(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(ends, "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    is_last = F.col("o_orderkey") == F.col("last.o_orderkey")
    is_first = F.col("o_orderkey") == F.col("first.o_orderkey")
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    dies = ((cust % 10 == 0) & is_last) | ((cust % 10 == 7) & is_first)
    segment = {"AUTOMOBILE": "Government", "BUILDING": "Medicaid", "FURNITURE": "Medicare", "HOUSEHOLD": "Private"}
    priority = {"1-URGENT": "URGENT", "2-HIGH": "EMERGENCY", "3-MEDIUM": "ELECTIVE", "4-NOT SPECIFIED": "NEWBORN"}

    def mapped(column: str, names: dict[str, str]) -> Column:
        chain = F
        for key, value in names.items():
            chain = chain.when(F.col(column) == key, value)
        return chain

    return joined.select(
        cust.cast("bigint").alias("subject_id"), order.alias("hadm_id"), "admittime", "dischtime",
        F.when(dies, F.expr("dischtime - INTERVAL '1' HOUR")).alias("deathtime"),
        _pick((order % 9).cast("int"), [
            "WHITE", "WHITE - RUSSIAN", "BLACK/AFRICAN AMERICAN", "HISPANIC OR LATINO", "LATIN AMERICAN",
            "ASIAN - CHINESE", "PORTUGUESE", "AMERICAN WHITE",
        ]).alias("ethnicity"),
        *_personal(cust),
        F.when(order % 20 == 0, 0).otherwise(1).alias("has_chartevents_data"),
        mapped("o_orderpriority", priority).alias("admission_type"),
        _pick((order % 6).cast("int"), ["CCU", "CSRU", "MICU", "SICU", "TSICU"]).alias("first_careunit"),
        mapped("c_mktsegment", segment).otherwise("Self Pay").alias("insurance"),
    )


def _timed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn(
        "admittime", F.expr("o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR")
    ).withColumn(
        "dischtime",
        F.expr("admittime + ((o_orderkey * 37) % 400) * INTERVAL '1' HOUR + (o_orderkey % 60) * INTERVAL '1' MINUTE"),
    )


def _subject_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last stay per subject."""
    return _timed_orders(spark, sf_dir).groupBy("o_custkey").agg(
        F.max("dischtime").alias("last_disch"),
        F.max(F.struct("admittime", "o_orderkey")).alias("last"),
        F.min(F.struct("admittime", "o_orderkey", "dischtime")).alias("first"),
    )


def _personal(cust: Column) -> list[Column]:
    return [
        F.when(cust % 2 == 0, "M").otherwise("F").alias("gender"),
        F.expr("TIMESTAMP_NTZ '1905-01-01 00:00:00' + ((o_custkey * 7919) % 36000) * INTERVAL '1' DAY").alias("dob"),
        F.when(cust % 5 == 0, F.expr(
            "CAST(CAST(last_disch AS DATE) AS TIMESTAMP_NTZ) + (o_custkey % 60) * INTERVAL '1' DAY"
        )).when(cust % 5 == 1, F.expr(
            "CAST(CAST(first.dischtime AS DATE) AS TIMESTAMP_NTZ) + (o_custkey % 61 - 5) * INTERVAL '1' DAY"
        )).alias("dod"),
    ]


def admissions_and_patients(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stay columns, and one row per subject: the two inputs of the base admissions."""
    cust = F.col("o_custkey")
    patients = _subject_ends(spark, sf_dir).select(cust.cast("bigint").alias("subject_id"), *_personal(cust))
    return stays(spark, sf_dir).drop("gender", "dob", "dod"), patients


def hosps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_admissions(*admissions_and_patients(spark, sf_dir))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("subject_id"))


def severity(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven score tables of ``stays``: some stays lack a score, some have a second row.

    The keys are written once: a union of seven tables with the joins of ``stays`` in each would sort them all in one task.
    """
    return _score_tables(stage_table(stays(spark, sf_dir).select("subject_id", "hadm_id"), "score-stays"))


def _score_tables(stay_keys: DataFrame) -> dict[str, DataFrame]:
    repeated = stay_keys.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).where("seq = 0 OR hadm_id % 4 = 0")
    return {
        name: repeated.where((F.col("hadm_id") + no) % 11 != 0).select(
            "subject_id", "hadm_id", "seq", ((F.col("hadm_id") * no + F.col("seq")) % 20).cast("int").alias(name)
        )
        for no, name in enumerate((*SEVERITY_SCORES, "meld"), 1)
    }


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``meas``: one measurement per event, three stays per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        (F.col("user_id") * 3 + F.expr(
            "CASE WHEN ts < TIMESTAMP_NTZ '2024-01-11 00:00:00' THEN 0 "
            "WHEN ts < TIMESTAMP_NTZ '2024-01-21 00:00:00' THEN 1 ELSE 2 END"
        )).alias("hadm_id"),
        "event_id", F.col("ts").alias("charttime"),
        F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 "
               "WHEN 'signup' THEN 4 ELSE 5 END").alias("itemid"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("valuenum"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 13 = 0 THEN NULL ELSE 0 END").alias("error"),
    )


def event_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``adm_ev``: the three stays of every user in ``events``."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    by_block = users.withColumn("blk", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    stay_id = F.col("user_id") * 3 + F.col("blk")
    return by_block.select(
        F.col("user_id").alias("subject_id"), stay_id.alias("hadm_id"), stay_id.alias("icustay_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + (blk * 10) * INTERVAL '1' DAY "
               "+ (user_id % 24) * INTERVAL '1' HOUR").alias("admittime"),
    )


# Item metadata of the stand-in measurements.
ITEMS = (
    (1, "heart rate", 1.0, 150.0), (2, "sodium", 2.0, 120.0), (3, "glucose", 0.5, 200.0), (4, "TempF", 10.0, 110.0),
    (5, "hemoglobin", 1.0, 90.0),
)
MEASURED_NAMES = ("heart rate", "sodium", "glucose", "TempC", "hemoglobin")


def items(spark: SparkSession, ids: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    rows = [r for r in ITEMS if r[0] in ids]
    return spark.createDataFrame(rows, "itemid int, `feature name` string, min double, max double")


VITAL_ITEMS, LAB_ITEMS = (1, 4), (2, 3, 5)


def icu_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``stay``."""
    return event_stays(spark, sf_dir).withColumn(
        "intime", F.expr("admittime + (subject_id % 7) * INTERVAL '1' HOUR + INTERVAL '30' MINUTE")
    ).drop("admittime")


def _stage(limits: tuple[int, int, int]) -> str:
    low, mid, high = limits
    return f"CASE WHEN valuenum > {high} THEN 3 WHEN valuenum > {mid} THEN 2 WHEN valuenum > {low} THEN 1 ELSE 0 END"


def kdigo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``kdigo``."""
    return measurements(spark, sf_dir).select(
        F.col("hadm_id").alias("icustay_id"), "charttime",
        F.expr("CASE WHEN itemid = 1 THEN valuenum END").alias("creat"),
        F.expr(f"CASE WHEN itemid = 1 THEN {_stage((30, 60, 100))} END").alias("aki_stage_creat"),
        F.expr(f"CASE WHEN itemid = 2 THEN {_stage((40, 80, 120))} END").alias("aki_stage_uo"),
        *[(F.col("valuenum") / float(h)).alias(f"uo_rt_{h}hr") for h in (6, 12, 24)],
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``hourly``: hourly means, wide."""
    return _by_hour(measurements(spark, sf_dir)).agg(*[
        F.expr(f"AVG(CASE WHEN itemid = {item} THEN {value} END)").alias(name)
        for item, name, value in (
            (1, "heart_rate", "valuenum"), (2, "sodium", "valuenum"), (3, "glucose", "valuenum"),
            (4, "temperature", "valuenum"), (5, "hemoglobin", "valuenum"), (1, "weight", "50 + valuenum"),
            (2, "height", "valuenum * 3"),
        )
    ])


def _by_hour(df: DataFrame):
    keyed = df.withColumn("icustay_id", F.col("hadm_id")).withColumn("hours_in", (F.col("event_id") % 60).cast("int"))
    return keyed.groupBy("subject_id", "hadm_id", "icustay_id", "hours_in")


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``interv``: hourly indicators."""
    return _by_hour(measurements(spark, sf_dir)).agg(*[
        F.max(F.when(F.col("itemid") == item, 1).otherwise(0)).alias(name) for item, name in ((3, "vent"), (4, "vaso"))
    ])


HOURLY_NAMES = ("heart_rate", "sodium", "glucose", "temperature", "hemoglobin", "weight", "height")
TREATED_NAMES = ("vent", "vaso")


def static_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``ext_static``: demographics, codes and outcomes of the event stays."""
    s = F.col("subject_id")
    return icu_stays(spark, sf_dir).join(
        event_stays(spark, sf_dir).select("icustay_id", "admittime"), "icustay_id"
    ).select(
        "subject_id", "hadm_id", "icustay_id", (20 + s % 65).cast("int").alias("age"),
        F.when(s % 2 == 0, "M").otherwise("F").alias("gender"),
        _pick((s % 5).cast("int"), ["WHITE", "BLACK", "HISPANIC OR LATINO", "ASIAN", "OTHER"]).alias("ethnicity"),
        _pick((s % 5).cast("int"), ["Government", "Medicaid", "Medicare", "Private", "Self Pay"]).alias("insurance"),
        _pick((s % 6).cast("int"), ["CCU", "CSRU", "MICU", "SICU", "TSICU"]).alias("first_careunit"),
        _pick((s % 4).cast("int"), ["ELECTIVE", "EMERGENCY", "URGENT"]).alias("admission_type"),
        "admittime", F.expr("admittime + (50 + subject_id * 13 % 180) * INTERVAL '1' HOUR").alias("dischtime"),
        F.expr("CASE WHEN subject_id % 6 = 0 THEN admittime + INTERVAL '49' HOUR END").alias("deathtime"),
        "intime", F.expr("intime + INTERVAL '40' HOUR").alias("outtime"),
        F.expr("CASE WHEN subject_id % 4 = 0 THEN 1 WHEN subject_id % 4 = 1 THEN 0 END").alias("dnr"),
        F.lit(0).alias("dnr_first"),
        F.expr("admittime + (subject_id % 90) * INTERVAL '1' HOUR + INTERVAL '59' MINUTE").alias("dnr_first_charttime"),
        F.lit("NONE").alias("diagnosis_at_admission"), F.lit("HOME").alias("discharge_location"),
        *[F.lit(0).alias(c) for c in (
            "fullcode", "fullcode_first", "cmo", "cmo_first", "cmo_last", "mort_icu", "mort_hosp",
            "hospital_expire_flag", "hospstay_seq", "readmission_30", "max_hours", "los_icu",
        )],
    )


def event_hosps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``ev_hosps``: base admissions of the event stays."""
    static = static_extract(spark, sf_dir)
    admissions = static.select(
        "subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "ethnicity",
        F.lit(1).alias("has_chartevents_data"),
    )
    patients = static.groupBy("subject_id").agg(
        F.min("gender").alias("gender"), F.min("age").alias("age"), F.min("dischtime").alias("left")
    ).select(
        "subject_id", "gender", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00' - age * INTERVAL '365' DAY").alias("dob"),
        F.expr("CASE WHEN subject_id % 7 = 0 THEN left + (subject_id % 60) * INTERVAL '1' DAY END").alias("dod"),
    )
    return base_admissions(admissions, patients)


def event_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``ev_cohort``: three of four users."""
    return table(spark, sf_dir, "events").where("user_id % 4 <> 3").select(F.col("user_id").alias("subject_id")).distinct()


def bundle(spark: SparkSession, sf_dir: str) -> ExtractBundle:
    return ExtractBundle(static_extract(spark, sf_dir), hourly(spark, sf_dir), interventions(spark, sf_dir))


SECOND_STAY = 1_000_000


def split_bundle(spark: SparkSession, sf_dir: str) -> ExtractBundle:
    """Views ``static2``, ``hourly2`` and ``interv2``: every third admission has a second ICU stay from hour 30 on."""
    base, twice, second = bundle(spark, sf_dir), F.col("hadm_id") % 3 == 0, F.col("hadm_id") + SECOND_STAY

    def moved(hours: DataFrame) -> DataFrame:
        return hours.withColumn("icustay_id", F.when(twice & (F.col("hours_in") >= 30), second).otherwise(F.col("icustay_id")))

    static = base.static.unionByName(base.static.where(twice).withColumn("icustay_id", second))
    return ExtractBundle(static, moved(base.hourly), moved(base.interventions))


def clinical(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    keys = event_stays(spark, sf_dir)
    scores = _score_tables(keys.select("subject_id", "hadm_id"))
    meld = scores.pop("meld")
    return ClinicalTables(
        severity=scores, meld=meld, icustays=icu_stays(spark, sf_dir).select("icustay_id", "intime"),
        kdigo=kdigo(spark, sf_dir), stay_map=keys.select("icustay_id", "subject_id", "hadm_id"), order="seq",
    )


def study(spark: SparkSession, sf_dir: str) -> StudyData:
    return StudyData(event_hosps(spark, sf_dir), bundle(spark, sf_dir), clinical(spark, sf_dir))


def event_tables(spark: SparkSession, sf_dir: str) -> EventTables:
    """Vital items as chart events, the other items as lab events."""
    all_events = measurements(spark, sf_dir)
    return EventTables(
        charts=all_events.where(F.col("itemid").isin(*VITAL_ITEMS)),
        labs=all_events.where(F.col("itemid").isin(*LAB_ITEMS)).drop("error"),
        chart_items=items(spark, VITAL_ITEMS), lab_items=items(spark, LAB_ITEMS),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``scored``: labelled documents with a score that has ties."""
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("y"),
        F.expr("ROUND(CAST((n_chars * 7 + quality * 300 + doc_id % 50) % 997 AS DOUBLE) / 997.0D, 2)").alias("score"),
    )


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``feat``: a feature matrix with planted gaps, an empty and a constant column."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 2).cast("int").alias("gender"),
        (18 + F.col("o_custkey") % 72).cast("int").alias("age"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("qty")).alias("qty"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("disc")).alias("disc"),
        F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("empty_col"),
        F.lit(1.0).alias("const_col"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("vent"),
        F.when((F.col("qty") > 120) | (F.col("o_orderkey") % 10 == 3), 1).otherwise(0).alias("y"),
    )
