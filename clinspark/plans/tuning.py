"""Grid search over stratified folds, with what candidates share fitted once."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinspark.config import DEFAULT_GRIDS, Learner
from clinspark.operators.ensembles import check_params, growth_of, staged_draws, to_vectors
from clinspark.operators.metrics import metric_report
from clinspark.operators.sampling import stratified_folds
from clinspark.operators.trees import Ensemble, Growth, fit_draws
from clinspark.plans.training import fit_preparation
from clinspark.session import stage_table

FOLDS = 5
SCORINGS = {"f1": "f1_score", "accuracy": "acc", "balanced_accuracy": "balanced_acc", "average_precision": "ap"}


@dataclass(frozen=True)
class SearchResult:
    best: dict[str, Any]
    scores: DataFrame | None


def expand_grid(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """The cross product with names in sorted order, the last name varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


@dataclass(frozen=True)
class Shared:
    """Trees fitted once, and the candidates they serve: ``(candidate, depth, trees of a member)``."""

    growth: Growth
    uses: tuple[tuple[int, int | None, int], ...]


def shared_growths(learner: Learner, candidates: Sequence[Mapping[str, Any]], n_features: int, bags: int) -> list[Shared]:
    """Forests that differ in depth or number of trees are parts of the largest one; so are boosted sums of fewer rounds."""
    served: dict[Growth, list[tuple[int, Growth]]] = {}
    for i, params in enumerate(candidates):
        growth = growth_of(learner, params, n_features, bags)
        # Splits don't depend on the depth allowed, as trees without a bound on leaves grow all of their nodes.
        alike = replace(growth, rounds=0, depth=0) if growth.leaves is None and growth.rate is None else replace(growth, rounds=0)
        served.setdefault(alike, []).append((i, growth))
    return [
        Shared(replace(alike, rounds=max(g.rounds for _, g in own), depth=max(g.depth for _, g in own)),
               tuple((i, g.depth if growth_is_cut(alike) else None, g.rounds) for i, g in own))
        for alike, own in served.items()
    ]


def growth_is_cut(alike: Growth) -> bool:
    return alike.depth == 0


def grid_search(
    data: DataFrame,
    learner: Learner,
    grid: Mapping[str, Sequence[Any]] | None = None,
    label: str = "target",
    key: str = "hadm_id",
    exclude: tuple[str, ...] = ("subject_id", "hadm_id", "target"),
    scoring: str = "f1",
    tune: bool = True,
    folds: int = FOLDS,
    bags: int = 10,
    seed: int = 0,
    fixed: Mapping[str, Any] | None = None,
) -> SearchResult:
    """Mean score over the folds for every parameter combination; ties go to the first in grid order.

    Preparation is refitted inside each fold, and the draws of a fold are those of all its candidates.  One job fits the
    trees of all folds, bags and candidates; one table holds the scores of all candidates, and one grouped report rates them.
    """
    if not tune:
        return SearchResult({}, None)
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}; choose one of {sorted(SCORINGS)}")
    candidates = expand_grid(DEFAULT_GRIDS[learner] if grid is None else grid)
    fixed = dict(fixed or {})
    for params in candidates:
        check_params(learner, {**fixed, **params})
    folded = stratified_folds(stage_table(data, "features"), label, key, folds)

    numbers, vectors, draws, width = range(1, folds + 1), {}, {}, 0
    for fold in numbers:
        preparation = fit_preparation(folded.where(F.col("fold") != fold).drop("fold"), exclude)
        rows = to_vectors(preparation.transform(folded), preparation.features, [key, label, "fold"])
        vectors[fold], width = stage_table(rows, f"fold-{fold}"), len(preparation.features)
        files = staged_draws(vectors[fold].where(F.col("fold") != fold), label, key, bags, seed, width)
        draws |= {(fold, b): (files, b) for b in range(bags)}
    shared = shared_growths(learner, [{**fixed, **p} for p in candidates], width, bags)
    trees = stage_table(
        fit_draws(data.sparkSession, draws, [s.growth for s in shared], width, seed, {"held": "int", "member": "int"}), "trees")

    scored = stage_table(reduce(DataFrame.unionByName, [
        _scored(vectors[fold].where(F.col("fold") == fold), trees.where(F.col("held") == fold), shared, learner, label, len(candidates))
        .withColumn("fold", F.lit(fold)) for fold in numbers]), "scored")
    report = metric_report(scored, groups=("candidate", "fold")).where(F.col("metric") == SCORINGS[scoring])
    names = data.sparkSession.createDataFrame(
        [(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(candidates)], "candidate int, params string")
    # A row per candidate and fold.
    scores = stage_table(report.join(names, "candidate").select("candidate", "params", "fold", F.col("value").alias("score")), "scores")
    means = {r["candidate"]: math.fsum(r["all"]) / folds
             for r in scores.groupBy("candidate").agg(F.collect_list("score").alias("all")).collect()}
    best = max(range(len(candidates)), key=lambda i: (means[i], -i))
    return SearchResult(candidates[best], scores.drop("candidate"))


def _scored(rows: DataFrame, trees: DataFrame, shared: Sequence[Shared], learner: Learner, label: str, candidates: int) -> DataFrame:
    """(y, candidate, score) of each row of one fold by each candidate."""
    flats = [Ensemble(trees.where(F.col("candidate") == i), learner is Learner.BOOSTED).flat for i in range(len(shared))]
    sent = rows.sparkSession.sparkContext.broadcast(flats)

    @F.arrow_udf("array<double>")
    def by_candidate(x: pa.Array) -> pa.Array:
        columns = [None] * candidates
        for flat, own in zip(sent.value, shared):
            for (candidate, *_), found in zip(own.uses, flat.probabilities(x, [(d, until) for _, d, until in own.uses])):
                columns[candidate] = found
        return pa.array([list(r) for r in zip(*columns)], pa.list_(pa.float64()))

    found = rows.select(F.col(label).alias("y"), by_candidate("features").alias("scores"))
    return found.select("y", F.posexplode("scores").alias("candidate", "score"))
