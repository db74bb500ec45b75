"""Global order operators against plain Python, with pieces small enough that every branch runs."""

import hashlib
import random
import re
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clinspark.operators.ordering import exact_medians, group_sizes, numbered, order_statistics, rank_values, running_totals
from clinspark.operators.sampling import balanced_draw, balanced_draws, balanced_limits, stratified_folds, stratified_split


@pytest.fixture(scope="module")
def values(spark):
    """A third of the rows share one value and two thirds one group."""
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", 7.0 if i % 3 == 1 else rng.gauss(0, 1e3)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(8).cache()


@pytest.mark.parametrize("piece", [10, 500, 10**6])
def test_order_statistics(spark, values, piece):
    rows, df = values
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    ranks = {("a",): [1, 17, 2000, 4000], ("b",): [1, 1000, 2000]}
    got = order_statistics(df, ["g"], "v", ranks, group_sizes(df, ["g"]), piece_rows=piece)
    assert got == {(g,): [sorted(groups[g])[k - 1] for k in ks] for (g,), ks in ranks.items()}


@pytest.mark.parametrize("piece", [50, 10**6])
def test_medians(spark, values, piece):
    rows, df = values
    assert exact_medians(df, ["v"], piece) == {"v": pytest.approx(statistics.median(v for _, v in rows))}


@pytest.mark.parametrize("piece", [50, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, values, piece, descending):
    rows, df = values
    counts = df.groupBy("g", "v").count()
    got = {(r.g, r.v): r.upto for r in running_totals(counts, "v", {"count": "upto"}, ["g"], descending, piece).collect()}
    for g in ("a", "b"):
        ordered = sorted((v for h, v in rows if h == g), reverse=descending)
        last = {v: i + 1 for i, v in enumerate(ordered)}
        assert {v: n for (h, v), n in got.items() if h == g} == last


def test_medians_of_300_columns(spark):
    """Columns of different lengths with ties, an empty one, and few values left to order after the brackets."""
    rng = random.Random(5)
    rows = [tuple(None if c == 299 or i % (c % 7 + 2) == 1 else float(rng.choice([i, c, 7])) for c in range(300)) for i in range(401)]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{c}` double" for c in range(300))).repartition(4)
    want = {}
    for c in range(300):
        values = [r[c] for r in rows if r[c] is not None]
        want[f"c.{c}"] = statistics.median(values) if values else 0.0
    assert exact_medians(df, list(want), 2_000) == want
    assert exact_medians(df, list(want)) == want


def test_ranks_of_several_series(spark, values):
    rows, df = values
    got = rank_values(
        df, ["g"], {"v": F.col("v"), "minus": -F.col("v")},
        {("v", ("a",)): [1, 2, 4000, 4001], ("minus", ("a",)): [1], ("minus", ("b",)): [2000]},
        {("v", ("a",)): 4000, ("minus", ("a",)): 4000, ("minus", ("b",)): 2000}, piece_rows=20,
    )
    a, b = (sorted(v for h, v in rows if h == g) for g in ("a", "b"))
    assert got == {("v", ("a",)): [a[0], a[1], a[-1], None], ("minus", ("a",)): [-a[-1]], ("minus", ("b",)): [-b[0]]}


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_of_null_and_nan(spark, descending):
    rows = [(None, 1), (float("nan"), 2), (float("inf"), 4), (float("-inf"), 8), (0.5, 16), (-0.0, 32)]
    df = spark.createDataFrame(rows, "v double, n bigint").repartition(3)
    got = {str(r.v): r.upto for r in running_totals(df, "v", {"n": "upto"}, descending=descending, piece_rows=2).collect()}
    order = ["None", "-inf", "-0.0", "0.5", "inf", "nan"]
    sizes, want, total = {str(v): n for v, n in rows}, {}, 0
    for v in reversed(order) if descending else order:
        want[v] = total = total + sizes[v]
    assert got == want


def test_running_totals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "v double, n bigint")
    assert running_totals(df, "v", {"n": "upto"}).collect() == []


@pytest.mark.parametrize("make", [
    lambda df: running_totals(df, "v", {"n": "upto"}), lambda df: running_totals(df, "v", {"n": "upto"}, ["g"]),
    lambda df: numbered(df, "v"),
])
def test_one_task_gets_totals_of_pieces_only(spark, make):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"), (F.col("id") % 2).alias("g"))
    lines = make(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if re.search(r"\bWindow \[", line)]
    assert len(windows) == 2
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[_piece" in lines[i + 1]


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(1000)], "k bigint").repartition(7)
    for piece in (64, 10**6):
        got = {r.k: r.row_no for r in numbered(df, "k", piece_rows=piece).collect()}
        assert got == {i * 3: i for i in range(1000)}


@pytest.fixture(scope="module")
def classed(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1003)]
    return rows, spark.createDataFrame(rows, "k bigint, y int").repartition(5)


@pytest.mark.parametrize("piece", [20, 10**6])
def test_split_is_stratified(classed, piece):
    rows, df = classed
    got = stratified_split(df, "y", "k", seed=3, piece_rows=piece).collect()
    for y in (0, 1):
        n = sum(1 for _, c in rows if c == y)
        assert sum(r.is_holdout for r in got if r.y == y) == round(0.2 * n)
    assert len(got) == len(rows)


def test_split_does_not_depend_on_partitions(classed):
    _, df = classed
    held = [
        {r.k for r in stratified_split(df.repartition(p), "y", "k", seed=3).where("is_holdout = 1").collect()} for p in (1, 4, 16)
    ]
    assert held[0] == held[1] == held[2]


@pytest.mark.parametrize("piece", [20, 10**6])
def test_folds_are_contiguous(classed, piece):
    rows, df = classed
    got = {r.k: r.fold for r in stratified_folds(df, "y", "k", 5, piece).collect()}
    for y in (0, 1):
        keys = sorted(k for k, c in rows if c == y)
        base, extra = divmod(len(keys), 5)
        want = [f + 1 for f in range(5) for _ in range(base + (f < extra))]
        assert [got[k] for k in keys] == want


def test_folds_of_a_tiny_class(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(12)], "k bigint, y int")
    got = stratified_folds(df, "y", "k").collect()
    assert sorted(r.fold for r in got if r.y == 1) == [1, 2]


def test_balanced_draws(classed):
    rows, df = classed
    minority = sum(c for _, c in rows)
    drawn = balanced_draws(df, "y", "k", seed=1, bags=2, piece_rows=30).collect()
    for bag in (0, 1):
        assert sum(1 for r in drawn if r.bag == bag and r.y == 0) == minority
        assert {r.k for r in drawn if r.bag == bag} == {r.k for r in balanced_draw(df, "y", "k", 1, bag).collect()}
    assert {r.k for r in drawn if r.bag == 0} != {r.k for r in drawn if r.bag == 1}


def test_thresholds_of_bags_copy_no_row(classed):
    """Limits of all bags come from wide rows, and each is the hash of the last row in the draw."""
    rows, df = classed
    limits = balanced_limits(df, "y", "k", seed=1, bags=range(40), piece_rows=30)
    quota = sum(c for _, c in rows)
    for bag in (0, 17, 39):
        for y in (0, 1):
            hashes = sorted(hashlib.md5(f"1:{bag}:{k}".encode()).hexdigest() for k, c in rows if c == y)
            assert limits[bag, y] == hashes[quota - 1]
