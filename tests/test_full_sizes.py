"""Registered model queries run the configured sizes, not smaller ones."""

import pytest

from clinspark.catalog import queries as q
from clinspark.config import FINAL_MODELS, Learner, ModelConfig, Outcome
from clinspark.operators import attribution

TRAINED = {
    "train_score_forest": Learner.FOREST, "train_score_boosted": Learner.BOOSTED, "calibrated_scores": Learner.FOREST,
    "forest_importance": Learner.FOREST, "attributions": Learner.FOREST, "top_k_by_attribution": Learner.FOREST,
    "train_score_forest_exact": Learner.FOREST, "train_score_boosted_exact": Learner.BOOSTED,
    "forest_importance_exact": Learner.FOREST,
}
SIZES = {
    Learner.FOREST: FINAL_MODELS[Outcome.PROLONGED_STAY].params, Learner.BOOSTED: FINAL_MODELS[Outcome.MORTALITY].params,
}


class Asked(Exception):
    """Raised in place of the work; holds how it was called."""


def catch(monkeypatch, owner, name):
    def caught(*args, **kwargs):
        raise Asked(args, kwargs)

    monkeypatch.setattr(owner, name, caught)


@pytest.mark.parametrize("name", TRAINED)
def test_training_queries_use_configured_sizes(spark, small_dir, monkeypatch, name):
    catch(monkeypatch, q, "train_model")
    with pytest.raises(Asked) as asked:
        q.QUERIES[name](spark, small_dir)
    (_, learner, params), given = asked.value.args
    assert (learner, params) == (TRAINED[name], SIZES[TRAINED[name]])
    assert "bags" not in given


def test_default_bags_are_the_configured_ones():
    assert ModelConfig.bags == 100 and {c.bags for c in FINAL_MODELS.values()} == {100}
    assert q.train_model.__defaults__[-1] == 100


def test_all_targets_train_the_final_models(spark, small_dir, monkeypatch):
    catch(monkeypatch, q, "train_all")
    with pytest.raises(Asked) as asked:
        q.QUERIES["score_all_targets"](spark, small_dir)
    args, given = asked.value.args
    assert len(args) == 2 and set(given) == {"save_to"}


def test_grid_search_takes_the_default_grid(spark, small_dir, monkeypatch):
    catch(monkeypatch, q, "grid_search")
    with pytest.raises(Asked) as asked:
        q.QUERIES["grid_search_scores"](spark, small_dir)
    args, given = asked.value.args
    assert args[1:] == (Learner.FOREST,) and not {"grid", "bags", "folds"} & set(given)


@pytest.mark.parametrize("name, called", [("attributions", "shapley_attributions"), ("top_k_by_attribution", "select_by_attribution")])
def test_attributions_take_the_default_permutations(spark, small_dir, monkeypatch, name, called):
    class Model:
        preparation = type("P", (), {"transform": staticmethod(lambda rows: rows)})
        features, members = (), ()

    monkeypatch.setattr(q, "train_model", lambda *a, **k: Model)
    catch(monkeypatch, attribution, called)
    with pytest.raises(Asked) as asked:
        q.QUERIES[name](spark, small_dir)
    assert "permutations" not in asked.value.args[1] and len(asked.value.args[0]) <= 5
