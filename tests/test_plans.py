"""What the plans must keep at scale: pushdown, pruning, pre-aggregation, no one-task steps, and skew."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clinspark.catalog import standins as s
from clinspark.catalog.queries import QUERIES
from clinspark.config import FeatureOptions
from clinspark.operators.cohort import first_stay, select_cohort
from clinspark.operators.labels import label_readmission
from clinspark.operators.measurements import window_events
from clinspark.plans.features import extract_features
from clinspark.session import stage_table
from clinspark.sources.extract import ExtractBundle


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_aggregates_before_every_shuffle(spark, small_dir, no_broadcast, tmp_path):
    for name, table in s.bundle(spark, small_dir).tables().items():
        table.write.parquet(f"{tmp_path}/{name}")
    bundle = ExtractBundle(*[spark.read.parquet(f"{tmp_path}/{n}") for n in s.bundle(spark, small_dir).tables()])
    hosps = stage_table(s.event_hosps(spark, small_dir), "hosps")
    text = plan(extract_features(bundle, hosps, s.event_cohort(spark, small_dir), FeatureOptions()))
    lines = text.splitlines()
    for column in ("heart_rate", "vaso"):
        scan = next(i for i, l in enumerate(lines) if "FileScan" in l and column in l)
        assert "LessThanOrEqual(hours_in,42)" in lines[scan].split("PushedFilters")[1]
        above = next(l for l in reversed(lines[:scan]) if "Exchange" in l or "Aggregate" in l)
        assert "Aggregate" in above and "partial_" in above


def test_unused_columns_are_not_read(spark, small_dir):
    text = plan(QUERIES["mortality_by_age_group"](spark, small_dir))
    orders = [l for l in text.splitlines() if "orders.parquet" in l]
    assert orders and all("o_totalprice" not in l and "o_orderpriority" not in l for l in orders)


def test_readmission_limits_each_group_before_the_shuffle(spark, small_dir):
    text = plan(label_readmission(s.hosps(spark, small_dir)))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {
    "train_score_forest", "train_score_boosted", "calibrated_scores", "score_all_targets", "grid_search_scores",
    "forest_importance", "attributions", "train_score_forest_exact", "train_score_boosted_exact", "forest_importance_exact"}))
def test_no_cartesian_product_and_no_python(spark, small_dir, name):
    text = plan(QUERIES[name](spark, small_dir))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", text)


HOSP = ("subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, "
        "dod timestamp_ntz, age int, los_hosp_hr double")


@pytest.fixture(scope="module")
def skewed(spark):
    """Subject 1 holds a third of all stays; stay 3 of subject 1 holds a third of all events."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 200 + 2).alias("subject_id"), F.col("id").alias("hadm_id"),
        F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + (id * 7919 % 3000) * INTERVAL '1' HOUR").alias("admittime"),
    )
    hosps = base.select(
        "subject_id", "hadm_id", "admittime", F.expr("admittime + INTERVAL '60' HOUR").alias("dischtime"),
        F.expr("CASE WHEN hadm_id % 5 = 0 THEN admittime END").alias("deathtime"),
        F.lit(None).cast("timestamp_ntz").alias("dod"), F.lit(40).alias("age"), F.lit(60.0).alias("los_hosp_hr"),
    ).cache()
    events = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id") % 3000).alias("hadm_id"), "id"
    ).join(base, "hadm_id").select(
        "subject_id", "hadm_id", F.expr("admittime + (id % 60) * INTERVAL '1' HOUR").alias("charttime"),
        F.lit(1).alias("itemid"), (F.col("id") % 97).cast("double").alias("valuenum"),
    ).cache()
    return hosps, events


def test_scores_share_one_exchange(spark, small_dir):
    text = plan(QUERIES["severity_merge"](spark, small_dir))
    assert "min_by" in text and "Join" not in text.split("Union")[0]


def test_scores_are_dealt_once_before_they_are_sorted(spark, tmp_path, no_broadcast):
    """No task that reads stays sorts or joins them for all score tables, and the rows are those of plain Python."""
    orders = [(k, None if k % 50 == 0 else k % 13, "1-URGENT") for k in range(1, 400)] + [(8, 8, "1-URGENT"), (None, 3, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").withColumn(
        "o_orderdate", F.lit("2020-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "BUILDING") for k in range(1, 12)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    merged = QUERIES["severity_merge"](spark, str(tmp_path))
    above, below = plan(merged).split("Exchange hashpartitioning(subject_id")
    assert above.count("SortAggregate") and not re.search("Sort|Aggregate|Join|Exchange", below)
    stays = {(c, k) for k, c, _ in orders if k is not None and c is not None and 1 <= c < 12}
    want = {(c, k, *(k * no % 20 for no in range(1, 8))) for c, k in stays if all((k + no) % 11 for no in range(1, 8))}
    assert sorted(tuple(r) for r in merged.collect()) == sorted(want)


def test_hot_subject(spark, skewed, no_broadcast):
    hosps, _ = skewed
    rows = hosps.collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.admittime, r.hadm_id)):
        first = want.setdefault(r.subject_id, {"hadm_id": r.hadm_id, "deathtime": None})
        first["deathtime"] = first["deathtime"] or r.deathtime
    got = {r.subject_id: {"hadm_id": r.hadm_id, "deathtime": r.deathtime} for r in first_stay(hosps).collect()}
    assert got == want
    assert {r.subject_id: r.hadm_id for r in first_stay(hosps, "row").collect()} == {k: v["hadm_id"] for k, v in want.items()}
    assert select_cohort(hosps, hosps.select("subject_id")).count() == len(want)
    labelled = Counter(r.target for r in label_readmission(hosps).collect())
    assert labelled[None] == len(rows) - len(want)


def test_hot_stay_is_split_and_complete(spark, skewed, no_broadcast):
    hosps, events = skewed
    items = spark.createDataFrame([(1,)], "itemid int")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = window_events(events.repartition(16), hosps, items).groupBy("subject_id", "hadm_id").agg(F.count("*").alias("n"))
        got = {r.hadm_id: r.n for r in found.collect()}
        final = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    admitted = {r.hadm_id: r.admittime for r in hosps.collect()}
    want = Counter(r.hadm_id for r in events.collect() if (r.charttime - admitted[r.hadm_id]).total_seconds() <= 42 * 3600)
    assert got == dict(want)
    assert "skew" in final.lower()


def test_same_result_for_any_number_of_partitions(spark, small_dir):
    seen = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, QUERIES["cohort_select"](spark, small_dir).select("subject_id", "hadm_id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] and seen[0] == seen[1] == seen[2]


def test_cohort_shrinks_at_each_step(spark, small_dir):
    steps = [r.n for r in QUERIES["cohort_funnel"](spark, small_dir).orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True)
    full = {r.subject_id for r in QUERIES["cohort_select"](spark, small_dir).collect()}
    assert {r.subject_id for r in QUERIES["cohort_select_no_death"](spark, small_dir).collect()} <= full
