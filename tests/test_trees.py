"""Histogram trees against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinspark.config import Learner
from clinspark.operators import ensembles, sampling
from clinspark.operators.trees import LEAF, Ensemble, Flat, Growth, fit_trees, grown

RNG = np.random.default_rng(5)


def table_of(trees, member=0):
    rows = []
    for t, nodes in trees:
        feature, threshold, left, value, gain = (list(c) for c in zip(*nodes))
        rows.append({"member": member, "tree": t, "feature": feature, "threshold": threshold, "left": left,
                     "value": value, "gain": gain})
    return pa.Table.from_pylist(rows)


def walked(nodes, x, depth=None):
    at, level = 0, 0
    while nodes[at][0] != LEAF and (depth is None or level < depth):
        at = nodes[at][2] + int(x[nodes[at][0]] > nodes[at][1])
        level += 1
    return nodes[at][3]


def best_by_loops(x, y, l2=0.0, min_leaf=1):
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            under = x[:, j] <= cut
            if min(under.sum(), (~under).sum()) < min_leaf:
                continue
            gain = sum(y[s].sum() ** 2 / (s.sum() + l2) for s in (under, ~under)) - y.sum() ** 2 / (len(y) + l2)
            if gain > best[0] + 1e-12:
                best = (gain, j, cut)
    return best


@pytest.mark.parametrize("l2, min_leaf", [(0.0, 1), (2.0, 1), (0.0, 20)])
def test_first_split_is_the_best_one(l2, min_leaf):
    x = np.round(RNG.standard_normal((120, 4)), 1)
    y = (x[:, 2] + 0.5 * RNG.standard_normal(120) > 0).astype(float)
    (_, nodes), = grown(x, y, Growth(1, depth=1, l2=l2, min_leaf=min_leaf), (0,))
    gain, feature, cut = best_by_loops(x, y, l2, min_leaf)
    assert nodes[0][0] == feature and math.isclose(nodes[0][1], cut) and math.isclose(nodes[0][4], gain)
    for child, side in ((nodes[0][2], x[:, feature] <= cut), (nodes[0][2] + 1, x[:, feature] > cut)):
        assert math.isclose(nodes[child][3], y[side].sum() / (side.sum() + l2))


def test_bounds_of_a_tree():
    x, y = RNG.standard_normal((400, 5)), (RNG.random(400) < 0.5).astype(float)
    (_, nodes), = grown(x, y, Growth(1, leaves=7), (0,))
    assert sum(n[0] == LEAF for n in nodes) == 7
    (_, nodes), = grown(x, y, Growth(1, min_leaf=30), (0,))
    flat = Flat.of(table_of([(0, nodes)]), False)
    found = flat.values(x)[:, 0]
    assert min(np.unique(found, return_counts=True)[1]) >= 30
    (_, nodes), = grown(x, np.zeros(400), Growth(1), (0,))
    assert len(nodes) == 1 and nodes[0][3] == 0


def test_a_shallow_tree_is_the_top_of_a_deep_one():
    x, y = RNG.standard_normal((300, 6)), (RNG.random(300) < 0.4).astype(float)
    deep = list(grown(x, y, Growth(3, depth=9, tried=2), (1, 0)))
    for depth in (1, 3, 6):
        shallow = list(grown(x, y, Growth(3, depth=depth, tried=2), (1, 0)))
        top = Flat.of(table_of(deep), False).values(x, depth)
        assert np.allclose(top, Flat.of(table_of(shallow), False).values(x))


def test_walking_all_trees_at_once():
    x, y = RNG.standard_normal((200, 4)), (RNG.random(200) < 0.5).astype(float)
    trees = [list(grown(x, y, Growth(4, rate=0.3, leaves=6), (m,))) for m in (0, 1)]
    flat = Flat.of(pa.concat_tables([table_of(t, m) for m, t in enumerate(trees)]), True)
    probe = RNG.standard_normal((50, 4))
    for until in (None, 2):
        want = [np.mean([1 / (1 + math.exp(-sum(walked(n, row) for _, n in member[:until]))) for member in trees]) for row in probe]
        have = flat.probability(pa.array([list(r) for r in probe], pa.list_(pa.float64())), until=until)
        assert np.allclose(have, want)


def test_boosting_lowers_the_log_loss_and_repeats():
    x = RNG.standard_normal((500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = list(grown(x, y, Growth(60, rate=0.3, leaves=8, min_leaf=5), (0,)))
    flat = Flat.of(table_of(trees), True)
    loss = [-np.mean(np.log(np.where(y == 1, p := flat.of_rows(x, until=k), 1 - p))) for k in (1, 10, 60)]
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.2
    assert trees == list(grown(x, y, Growth(60, rate=0.3, leaves=8, min_leaf=5), (0,)))


def test_many_distinct_values_and_constant_columns():
    x = np.column_stack([RNG.standard_normal(3000), np.full(3000, 2.0), RNG.integers(0, 2, 3000)])
    y = (x[:, 0] > 0.123).astype(float)
    (_, nodes), = grown(x, y, Growth(1, depth=1, bins=255), (0,))
    assert nodes[0][0] == 0 and abs(nodes[0][1] - 0.123) < 0.05


def test_fit_is_one_table_for_any_number_of_draws(spark):
    rows = spark.range(600).select(
        F.col("id"), (F.col("id") % 2).cast("double").alias("label"),
        F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    draws = rows.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    trees = fit_trees(draws, [Growth(2, depth=3), Growth(1, depth=1)], 2, 0, "id", 5)
    assert trees.count() == 15 and trees.where("candidate = 1").count() == 5
    one = Ensemble(trees.where("candidate = 0"), False)
    assert {round(r.p, 9) - r.label for r in rows.select("label", one.probability(F.col("features")).alias("p")).collect()} == {0.0}
    shares = {r.feature: r.importance for r in one.importances(["a", "b"]).where("member = 0 AND tree = 0").collect()}
    assert shares == {"a": 1.0, "b": 0.0}


def test_draws_are_balanced_and_bounded(spark):
    rows = spark.range(3000).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.array(F.col("id").cast("double")).alias("features"))
    for most, each in ((50_000, 300), (200, 100)):
        found = ensembles.drawn(rows, "y", "id", 3, 0, most).groupBy("member", "label").count().collect()
        assert {(r.member, r.label): r["count"] for r in found} == {(m, y): each for m in range(3) for y in (0.0, 1.0)}


@pytest.mark.parametrize("leaves, kind", [(4, np.uint8), (9, np.uint16), (30, np.uint32), (60, np.uint64), (200, None)])
@pytest.mark.parametrize("rate", [0.3, None])
def test_look_ups_and_walks_agree_with_loops(leaves, kind, rate):
    x, y = np.round(RNG.standard_normal((900, 4)), 2), (RNG.random(900) < 0.5).astype(float)
    trees = [list(grown(x[m::2], y[m::2], Growth(3, rate=rate, leaves=leaves), (m,))) for m in (0, 1)]
    flat = Flat.of(pa.concat_tables([table_of(t, m) for m, t in enumerate(trees)]), rate is not None)
    assert flat.bits is kind
    probe = np.vstack([np.round(RNG.standard_normal((60, 4)), 2), [[np.nan, np.inf, -np.inf, 0.0]], x[:40]])
    for until in (None, 1):
        sums = [[[walked(n, row) for _, n in member[:until]] for member in trees] for row in probe]
        want = [np.mean([1 / (1 + math.exp(-sum(s))) if rate else np.mean(s) for s in row]) for row in sums]
        assert np.allclose(flat.of_rows(probe, until=until), want)
        assert np.allclose(flat.walked(probe, [(None, until)])[0], want)
        shallow = [np.mean([np.mean([walked(n, row, 2) for _, n in member[:until]]) for member in trees]) for row in probe]
        if not rate:
            assert np.allclose(flat.of_uses(probe, [(2, until), (None, until)]), [shallow, want])


def test_draws_hash_each_row_once_and_are_the_balanced_ones(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 3500).alias("id"), (F.col("id") % 7 == 0).cast("int").alias("y"),
                                    F.array(F.col("id").cast("double")).alias("features"))
    of = lambda df: sorted((r.bag, r.id, r.y, *r.features) for r in df.collect())
    limits = {most: sampling.balanced_limits(rows, "y", "id", 3, range(4), most=most) for most in (100, 10_000)}
    want = {most: of(rows.withColumn("bag", F.explode(sampling.bags_of_row("y", "id", 3, 4, limits[most])))) for most in limits}
    gaps = rows.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))
    found = sampling.balanced_limits(gaps, "y", "id", 3, range(2))
    sparse = of(gaps.withColumn("bag", F.explode(sampling.bags_of_row("y", "id", 3, 2, found))))
    assert of(sampling.bounded_draws(gaps, "y", "id", 3, 2, 10_000)) == sparse
    monkeypatch.setattr(sampling, "balanced_limits", None)  # the search over all rows
    for most in want:
        assert of(sampling.bounded_draws(rows, "y", "id", 3, 4, most)) == want[most]


def test_draws_are_fitted_whole(spark):
    """The leaves of a tree count every row of a draw, here 120,000 of 150,000."""
    rows = spark.range(150_000).select(
        F.col("id"), (F.col("id") % 5 < 2).cast("int").alias("y"), F.array((F.col("id") % 3000 == 0).cast("double")).alias("features"))
    model = ensembles.fit_members(rows, 1, "y", "id", Learner.FOREST, {"max_depth": 1, "n_estimators": 2}, 2, 0)
    for tree in model.table.collect():
        assert tree.feature[0] == 0 and tree.value[:2] == [0.5, (60_000 - 50) / (120_000 - 50)]


@pytest.mark.parametrize("rate", [0.3, None])
def test_rows_in_pieces_and_scratch_files_give_the_same_trees(monkeypatch, rate):
    x = np.column_stack([np.round(RNG.standard_normal(3000), 2), RNG.standard_normal(3000), np.ones(3000)])
    y = (x[:, 0] + RNG.standard_normal(3000) > 0).astype(float)
    growth = Growth(3, rate=rate, leaves=20, min_leaf=5, bins=100)
    want = list(grown(x, y, growth, (0,)))
    monkeypatch.setattr("clinspark.operators.trees.ROWS_AT_ONCE", 37)
    monkeypatch.setattr("clinspark.operators.trees.HELD_BYTES", 0)
    got = list(grown(x, y, growth, (0,)))
    for (_, some), (_, others) in zip(got, want, strict=True):
        assert [n[:3] for n in some] == [n[:3] for n in others]
        assert np.allclose([n[3:] for n in some], [n[3:] for n in others])


@pytest.mark.parametrize("gaps", [False, True])
def test_limits_of_large_classes_come_from_rows_near_them(spark, monkeypatch, gaps):
    key = F.when(F.col("id") % 10 > 0, F.col("id")) if gaps else F.col("id") % 35_000
    rows = spark.range(40_000).select(key.alias("id"), (F.col("id") % 7 < 3).cast("int").alias("y"))
    want = sampling.balanced_limits(rows, "y", "id", 3, range(3))
    if not gaps:
        monkeypatch.setattr(sampling, "balanced_limits", None)  # the search over all rows
    found = sampling.draw_limits(rows, "y", "id", 3, 3)
    of = lambda limits: sorted(map(tuple, rows.select("id", F.explode(sampling.bags_of_row("y", "id", 3, 3, limits))).collect()))
    assert of(found) == of(want) and len(of(found)) > 0
