"""Feature importance of forests, sampled per-row attributions and feature selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clinspark.config import Learner
from clinspark.operators.ensembles import RiskModel, dealt_evenly, mean_probability
from clinspark.operators.trees import distinct_places, matrix
from clinspark.session import stage_table

ALWAYS_KEPT = ("gender", "age")
PROBE_CELLS = 2_000_000  # feature values of probes that a task makes at once


def forest_importance(model: RiskModel) -> DataFrame:
    """Mean and population deviation of the impurity importance over all trees, largest first."""
    if model.learner is not Learner.FOREST:
        raise ValueError("importances over trees are defined for forests")
    return model.members.importances(model.features).groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("deviation")
    ).orderBy(F.desc("importance"), "feature")


def shapley_attributions(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    baseline: Mapping[str, float],
    permutations: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Sampled Shapley values of every row, ``(key, feature, attribution)``, for any scorer.

    Each row is repeated once per permutation and step; step s takes its first s features from the row and the
    others from the baseline.  ``score`` adds ``raw_score`` to a frame with a list ``features``.  A feature's
    value is the mean score difference when it enters, so the values of a row add up to f(row) - f(baseline).

    Features that have their baseline value change no score when they enter, so permutations go over the others, and
    equal probes of a row are scored once.  Each counts with a weight per feature: how often that feature entered at its
    step, less how often it enters next.  Rows are dealt before they are repeated, and ``score`` should leave the probes in
    their task: then only one row of sums is shuffled for each given row.
    """
    n = len(features)
    row = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    base = dealt_evenly(df.select(F.col(key), F.col(key).cast("string").alias("_k"), row.alias("features")))
    start = np.array([float(baseline[c]) for c in features])
    kind = df.select(key).schema[0].dataType.simpleString()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PROBE_CELLS // (permutations * (n + 1) * n))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found, cells, weights = probes(matrix(part["features"], n), part["_k"].to_pylist(), start, permutations, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found)), _lists(cells), _lists(weights)], [key, "features", "_w"])

    scored = score(base.mapInArrow(repeated, f"`{key}` {kind}, features array<double>, _w array<int>"))
    times = [F.get("_w", F.lit(j)) for j in range(n)]
    # A score that does not count is left out, as it may be no number.
    sums = [F.sum(F.when(w != 0, F.col("raw_score") * w).otherwise(0.0)) / permutations for w in times]
    whole = scored.groupBy(key).agg(*[s.alias(f"_s{j}") for j, s in enumerate(sums)])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_s{j}").alias("attribution")) for j, c in enumerate(features)]
    return whole.select(key, F.inline(F.array(*cells)))


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, values.ravel())


def probes(
    x: np.ndarray, keys: Sequence[str | None], start: np.ndarray, permutations: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, features, weights) of the distinct probes of the rows ``x``.

    The order of a permutation is that of the hashes ``md5("seed:permutation:position:key")``; equal features come last.
    """
    rows, n = x.shape
    moved = x != start
    prefix = [[f"{seed}:{p}:{j}:".encode() for j in range(n)] for p in range(permutations)]
    digests = np.zeros((rows, permutations, n), "V16")
    for i, key in enumerate(keys):
        if key is not None:
            text, own = key.encode(), np.flatnonzero(moved[i])
            joined = b"".join([md5(of[j] + text).digest() for of in prefix for j in own.tolist()])
            digests[i][:, own] = np.frombuffer(joined, "V16").reshape(permutations, len(own))
    halves = digests.view(">u8").reshape(rows, permutations, n, 2)
    still = np.broadcast_to(~moved[:, None, :], halves.shape[:3])
    order = np.lexsort((halves[..., 1], halves[..., 0], still), axis=-1)
    rank = np.argsort(order, axis=-1)
    # Steps after the last moved feature repeat the whole row and count for nothing.
    count = moved.sum(axis=1)
    row, permutation, step = np.nonzero(np.broadcast_to(
        np.arange(n + 1) <= count[:, None, None], (rows, permutations, n + 1)))
    held = (rank[row, permutation] < step[:, None]) & moved[row]
    cells = np.where(held, x[row], start)
    first, where = distinct_places(np.column_stack((cells, row.astype(np.float64))))
    weights = np.zeros((len(first), n), np.int32)
    now, later = step > 0, step < count[row]
    np.add.at(weights, (where[now], order[row[now], permutation[now], step[now] - 1]), 1)
    np.add.at(weights, (where[later], order[row[later], permutation[later], step[later]]), -1)
    return row[first], cells[first], weights


def top_features(
    attributions: DataFrame, k: int = 75, always: Sequence[str] = ALWAYS_KEPT, value: str = "attribution"
) -> DataFrame:
    """The ``k`` features with the largest mean absolute attribution, then the forced names that are not among them.

    ``(position, feature, importance)``; up to k + 2 rows.
    """
    spark = attributions.sparkSession
    forced = spark.createDataFrame([(name, i) for i, name in enumerate(always, 1)], "feature string, forced int")
    # Written: a row per feature, from scoring all probes.
    means = stage_table(attributions.groupBy("feature").agg(F.avg(F.abs(F.col(value))).alias("importance")), "importances")
    # From here on there are as many rows as features.
    ranked = means.join(forced, "feature", "full_outer").withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "feature"))
    )
    chosen = ranked.where((F.col("rank") <= k) | F.col("forced").isNotNull())
    place = F.when(F.col("rank") <= k, F.col("rank")).otherwise(F.lit(k) + F.col("forced"))
    return chosen.select(F.row_number().over(Window.orderBy(place)).alias("position"), "feature", "importance")


def select_by_attribution(
    model: RiskModel, df: DataFrame, key: str, k: int = 75, permutations: int = 8, seed: int = 0
) -> DataFrame:
    """Feature selection for a fitted model of any kind: attributions of the given rows, then the top ``k``.

    Prepared numerical features are centred, so the baseline is the average row of the training data with
    nothing set among the passed-through columns.
    """
    attributed = shapley_attributions(
        model.preparation.transform(df), key, model.features, lambda v: mean_probability(v, model.members, deal=False),
        dict.fromkeys(model.features, 0.0), permutations, seed,
    )
    return top_features(attributed, k)
