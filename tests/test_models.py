import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinspark.config import FeatureOptions, Learner
from clinspark.operators import attribution, ensembles, metrics
from clinspark.operators.ensembles import RiskModel
from clinspark.plans import tuning
from clinspark.plans.scoring import outer_join_predictions
from clinspark.plans.training import train_model
from clinspark.plans.tuning import expand_grid, grid_search

ARGS = dict(label="y", key="row_id", exclude=("row_id", "y"))


@pytest.fixture(scope="module")
def data(spark):
    """Two informative columns, one noise column, gaps, and one positive in five."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        y = int(rng.random() < 0.2)
        rows.append((i, y, rng.randint(18, 89), rng.randint(0, 1), rng.gauss(2.0 * y, 0.7) if rng.random() < 0.9 else None,
                     rng.gauss(-1.5 * y, 0.8), rng.random(), rng.choice([0, 1, None])))
    return spark.createDataFrame(rows, "row_id bigint, y int, age int, gender int, a double, b double, noise double, vent int").cache()


@pytest.fixture(scope="module")
def forest(data):
    return train_model(data, Learner.FOREST, {"max_depth": 4, "n_estimators": 10, "max_features": 3}, bags=2, **ARGS)


@pytest.mark.parametrize("which", ["forest", "boosted"])
def test_separable_data_is_ranked(data, forest, which):
    model = forest if which == "forest" else train_model(
        data, Learner.BOOSTED, {"max_iter": 5, "max_leaf_nodes": 8}, bags=2, **ARGS)
    scored = model.score(data, ["row_id", "y"])
    assert scored.columns == ["row_id", "y", "raw_score", "probability", "predicted"]
    assert metrics.average_precision(scored, score="raw_score").first().ap > 0.8
    assert scored.where("probability < 0 OR probability > 1 OR probability IS NULL").count() == 0
    pairs = scored.select("raw_score", "probability").orderBy("raw_score").collect()
    assert all(x.probability <= z.probability + 1e-12 for x, z in zip(pairs, pairs[1:]))


def test_saved_model_scores_the_same(spark, data, forest, tmp_path):
    forest.save(str(tmp_path / "m"))
    loaded = RiskModel.load(str(tmp_path / "m"), spark)
    key = ["row_id"]
    assert sorted(forest.score(data, key).collect()) == sorted(loaded.score(data, key).collect())


def test_calibrator_pools_and_interpolates(spark):
    points = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "raw_score double, y int")
    model = ensembles.fit_calibrator(points, "y")
    asked = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "raw_score double")
    got = [r.probability for r in ensembles.calibrate(asked, model, "raw_score").orderBy("raw_score").collect()]
    assert got == pytest.approx([0, 0.25, 1])


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="unknown"):
        ensembles.check_params(Learner.FOREST, {"depth": 3})
    with pytest.raises(ValueError, match="learner"):
        ensembles.check_params("svm", {})
    boosted = ensembles.growth_of(Learner.BOOSTED, {"max_leaf_nodes": 50, "l2_regularization": 0.25}, 5, 100)
    assert (boosted.leaves, boosted.l2, boosted.rounds, boosted.rate, boosted.min_leaf) == (50, 0.25, 100, 0.1, 20)
    tree = ensembles.growth_of(Learner.FOREST, {"min_samples_split": 4, "max_features": 15, "n_estimators": 100}, 5, 10)
    assert (tree.min_split, tree.tried, tree.rounds, tree.rate) == (4, 5, 10, None)


def test_options_that_contradict():
    with pytest.raises(ValueError):
        FeatureOptions(minimal=True, extended=True)


def test_importance(forest):
    rows = attribution.forest_importance(forest).collect()
    assert {r.feature for r in rows[:2]} == {"a", "b"}
    assert sum(r.importance for r in rows) == pytest.approx(1, abs=1e-6)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_attributions_add_up(spark, data, forest):
    names = forest.features
    prepared = forest.preparation.transform(data.where("row_id < 40"))
    baseline = dict.fromkeys(names, 0.0)
    score = lambda v: ensembles.mean_probability(v, forest.members)
    got = attribution.shapley_attributions(prepared, "row_id", names, score, baseline, permutations=3, seed=2)
    sums = {r.row_id: r.total for r in got.groupBy("row_id").agg(F.sum("attribution").alias("total")).collect()}
    raw = {r.row_id: r.raw_score for r in score(ensembles.to_vectors(prepared, names, ["row_id"])).collect()}
    zero = spark.createDataFrame([(0, *[0.0] * len(names))], "row_id int, " + ", ".join(f"`{n}` double" for n in names))
    start = score(ensembles.to_vectors(zero, names, ["row_id"])).first().raw_score
    assert len(sums) == 40
    for key, total in sums.items():
        assert total == pytest.approx(raw[key] - start, abs=1e-9)


def test_top_features_keep_forced_names(spark):
    rows = [("a", 3.0), ("a", -3.0), ("b", 2.0), ("c", 1.0), ("gender", 0.1), ("age", 0.2)]
    df = spark.createDataFrame(rows, "feature string, attribution double")
    assert [r.feature for r in attribution.top_features(df, 2).orderBy("position").collect()] == ["a", "b", "gender", "age"]
    assert [r.feature for r in attribution.top_features(df, 5).orderBy("position").collect()] == ["a", "b", "c", "age", "gender"]
    alone = attribution.top_features(df.where("feature = 'a'"), 1).orderBy("position").collect()
    assert [r.feature for r in alone] == ["a", "gender", "age"]


def test_outer_join_of_predictions(spark):
    part = lambda name, *subjects: spark.createDataFrame([(s, 0.5) for s in subjects], f"subject_id bigint, {name} double")
    got = outer_join_predictions([part("m", 1, 2), part("p", 2), part("r", 2, 3)]).orderBy("subject_id").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, None, None), (2, 0.5, 0.5, 0.5), (3, None, None, 0.5)]


def test_grid_search_shares_trees(data):
    """Candidates that differ in depth or number of trees have the scores of their own fits."""
    grid = {"max_depth": [2, 5], "n_estimators": [2, 4], "max_features": [2]}
    together = {(r.params, r.fold): r.score for r in grid_search(data, Learner.FOREST, grid, bags=2, folds=3, **ARGS).scores.collect()}
    assert len(together) == 12
    for one in expand_grid(grid)[1:3]:
        alone = grid_search(data, Learner.FOREST, {k: [v] for k, v in one.items()}, bags=2, folds=3, **ARGS).scores.collect()
        assert {(r.params, r.fold): r.score for r in alone}.items() <= together.items()
    stages = {"max_iter": [2, 6], "max_leaf_nodes": [4], "learning_rate": [0.1, 1.0]}
    result = grid_search(data, Learner.BOOSTED, stages, scoring="average_precision", bags=2, folds=3, **ARGS)
    assert result.scores.count() == 12 and all(0.3 < r.score <= 1 for r in result.scores.collect())


def test_grid_search(data):
    grid = {"max_depth": [1, 4], "n_estimators": [4]}
    result = grid_search(data, Learner.FOREST, grid, bags=1, folds=3, **ARGS)
    rows = result.scores.collect()
    assert len(rows) == 6 and {r.fold for r in rows} == {1, 2, 3}
    mean = lambda p: sum(r.score for r in rows if json.loads(r.params) == p)
    assert result.best == max(expand_grid(grid), key=mean)
    assert grid_search(data, Learner.FOREST, grid, tune=False, **ARGS).best == {}
    with pytest.raises(ValueError):
        grid_search(data, Learner.FOREST, grid, scoring="auc", **ARGS)


def test_attributions_are_those_of_plain_permutations(spark):
    """Whole permutations by loops, with features at their baseline value, equal rows of one key and a missing key."""
    rows = [(1, 2.0, 0.0, -1.0, 5.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 3.0, 1.0, 1.0), (None, 2.0, 2.0, 2.0, 2.0)]
    names, baseline = ("a", "b", "c", "d"), {"a": 0.0, "b": 0.0, "c": 1.0, "d": 1.0}
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, d double")
    at = lambda j: F.get("features", F.lit(j))
    score = lambda v: v.withColumn("raw_score", at(0) * at(1) + at(2) * at(3) + at(0))
    got = attribution.shapley_attributions(df, "row_id", names, score, baseline, permutations=3, seed=2).collect()
    want, plain = {}, lambda v: v[0] * v[1] + v[2] * v[3] + v[0]
    for key, *x in rows:
        for p in range(3):
            v = [baseline[c] for c in names]
            text = lambda j: "" if key is None else hashlib.md5(f"2:{p}:{j}:{key}".encode()).hexdigest()
            for j in sorted(range(4), key=lambda j: (text(j), j)):
                before, v[j] = plain(v), x[j]
                want[key, names[j]] = want.get((key, names[j]), 0) + (plain(v) - before) / 3
    assert {(r.row_id, r.feature): r.attribution for r in got} == pytest.approx(want) and len(got) == len(want)


def test_probes_are_few_and_stay_in_their_task(data, forest):
    """Scoring of probes follows no exchange of probes: one deals the rows, the other moves a row of sums per row."""
    prepared = forest.preparation.transform(data)
    dealt = lambda v: ensembles.mean_probability(v, forest.members, deal=False)
    found = attribution.shapley_attributions(prepared, "row_id", forest.features, dealt, dict.fromkeys(forest.features, 0.0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.index("MapInArrow")].count("Exchange") == 1
    x = np.array([[0.0, 1.0, 2.0], [0.0, 0.0, 0.0]])
    rows, cells, weights = attribution.probes(x, ["1", "2"], np.zeros(3), 8, 0)
    assert len(rows) <= 5 and not weights[:, 0].any() and not weights.sum(axis=0).any()
    assert len({(r, *c) for r, c in zip(rows.tolist(), cells.tolist())}) == len(rows)


def test_grid_search_fits_whole_draws(spark, monkeypatch):
    """The leaves of a tree count every row of a draw, here 60,000 of the 75,000 outside a fold."""
    rows = spark.range(150_000).select(
        F.col("id").alias("row_id"), (F.col("id") % 5 < 2).cast("int").alias("y"), F.lit(50).alias("age"),
        F.lit(1).alias("gender"), (F.col("id") % 3000 == 0).cast("int").alias("vent"))
    fitted = []

    def caught(scored, found, *rest):
        fitted.extend(found.collect())
        return scored_by(scored, found, *rest)

    scored_by = tuning._scored
    monkeypatch.setattr(tuning, "_scored", caught)
    grid = {"max_depth": [1], "n_estimators": [1], "max_features": [9]}
    scores = grid_search(rows, Learner.FOREST, grid, scoring="accuracy", bags=1, folds=2, **ARGS).scores
    assert scores.count() == 2 and len(fitted) == 2
    for tree in fitted:
        assert tree.value[:2] == [0.5, (30_000 - 25) / (60_000 - 25)]
