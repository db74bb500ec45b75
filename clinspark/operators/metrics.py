"""Evaluation of scored rows ``(y, score)``; every result is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.config import BOOTSTRAP_DRAWS, BOOTSTRAP_SHARE, CURVE_GRID_POINTS
from clinspark.operators.ordering import PIECE_ROWS, numbered, running_totals
from clinspark.operators.sampling import hash_number
from clinspark.session import stage_table

DECISION_LIMIT = 0.5


def predicted(score: Column) -> Column:
    """The more probable class; a tie goes to class 0."""
    return (score > DECISION_LIMIT).cast("int")


def confusion(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Counts on the full 2 x 2 grid, ``(y, predicted, n)``."""
    pred = predicted(F.col(score))
    cells = [(t, p) for t in (0, 1) for p in (0, 1)]
    counts = scored.agg(
        *[F.count(F.when((F.col(y) == t) & (pred == p), 1)).alias(f"_{t}{p}") for t, p in cells]
    )
    rows = [F.struct(F.lit(t).alias("y"), F.lit(p).alias("predicted"), F.col(f"_{t}{p}").alias("n")) for t, p in cells]
    return counts.select(F.inline(F.array(*rows)))


def _class_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    called = F.col("score") > DECISION_LIMIT
    total = lambda column, condition: F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("double")
    cells = counts.groupBy(*groups).agg(
        total("pos", called).alias("tp"), total("neg", called).alias("fp"),
        total("pos", ~called).alias("fn"), total("neg", ~called).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recalls = [F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)]
    # Only the classes that occur have a recall to average.
    known = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in recalls), F.lit(0))
    summed = sum((F.coalesce(r, F.lit(0.0)) for r in recalls), F.lit(0.0))
    return cells.select(
        *groups, F.try_divide(tp + tn, tp + fp + fn + tn).alias("acc"),
        F.try_divide(summed, known).alias("balanced_acc"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
    )


def score_counts(scored: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, staged.

    The only step that sees every scored row, so whatever produced the scores runs once; all curves and metrics
    work on this table.
    """
    counts = scored.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(F.lit(1) - F.col(y).cast("bigint")).alias("neg")
    )
    return stage_table(counts, "score-counts")


def curve_counts(counts: DataFrame, groups: Sequence[str] = (), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """True and false positives when everything at or above each score is called positive, with class totals."""
    running = running_totals(
        counts, "score", {"pos": "tp", "neg": "fp"}, groups, descending=True, piece_rows=piece_rows
    )
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if not groups:
        return running.withColumns(
            {c: totals.select(c).scalar() for c in ("n_pos", "n_neg")}
        )
    # One row per group, and groups are bootstrap draws.
    return running.join(F.broadcast(totals), list(groups))


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(1.0))


def _end_point(df: DataFrame, **values: float | None) -> DataFrame:
    """The fixed end point of a curve as a one-row frame with the same columns."""
    row = [F.lit(values[c]).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return df.sparkSession.range(1).select(*row)


def pr_points(scored: DataFrame, y: str = "y", score: str = "score", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, and the end point (1, 0) without a threshold."""
    counted = curve_counts(score_counts(scored, y, score), piece_rows=piece_rows)
    points = counted.select(
        F.col("score").alias("threshold"), _precision().alias("precision"), _recall().alias("recall")
    )
    return points.unionByName(_end_point(points, threshold=None, precision=1.0, recall=0.0))


def roc_points(scored: DataFrame, y: str = "y", score: str = "score", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, starting at (0, 0) without a threshold."""
    counted = curve_counts(score_counts(scored, y, score), piece_rows=piece_rows)
    points = counted.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    return points.unionByName(_end_point(points, threshold=None, fpr=0.0, tpr=0.0))


def _ranking_metrics(counts: DataFrame, piece_rows: int, floor: float = 0.8, groups: Sequence[str] = ()) -> DataFrame:
    """Average precision and the recall at a precision floor in one aggregate.

    The recall gained at a score is its own positives over all positives, so the step sum needs no ``lag``.
    """
    counted = curve_counts(counts, groups, piece_rows)
    gain = F.coalesce(F.try_divide(F.col("pos"), F.col("n_pos")), F.lit(0.0))
    return counted.groupBy(*groups).agg(
        F.coalesce(F.max(F.when(_precision() >= floor, _recall())), F.lit(0.0)).alias("PR80"),
        F.coalesce(F.sum(gain * _precision()), F.lit(0.0)).alias("ap"),
    )


def average_precision(
    scored: DataFrame, y: str = "y", score: str = "score", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    return _ranking_metrics(score_counts(scored, y, score), piece_rows).select("ap")


def recall_at_precision(
    scored: DataFrame, floor: float = 0.8, y: str = "y", score: str = "score", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Highest recall among points with precision of at least ``floor``; 0 if only the end point qualifies."""
    counts = score_counts(scored, y, score)
    return _ranking_metrics(counts, piece_rows, floor).select(F.col("PR80").alias("recall"))


def metric_report(
    scored: DataFrame, subset: str = "test", y: str = "y", score: str = "score", piece_rows: int = PIECE_ROWS,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Five rows ``(metric, subset, value)``: acc, balanced_acc, f1_score, PR80, ap; as many for each of ``groups``."""
    counts = score_counts(scored, y, score, groups)
    classes, ranking = _class_metrics(counts, groups), _ranking_metrics(counts, piece_rows, groups=groups)
    parts = [(classes, ("acc", "balanced_acc", "f1_score")), (ranking, ("PR80", "ap"))]
    rows = [
        df.select(*groups, F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.lit(subset).alias("subset"), F.col(n).alias("value")) for n in names
        ])))
        for df, names in parts
    ]
    return rows[0].unionByName(rows[1])


def calibration_bins(scored: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal-width bins (a, b], the first including 0; empty bins dropped."""
    edges = [i / bins for i in range(1, bins)]
    index = sum(((F.col(score) > e).cast("int") for e in edges), F.lit(0))
    return scored.groupBy(index.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("fraction_positive"),
        F.count("*").alias("n"),
    )


def score_histogram(scored: DataFrame, score: str = "score", bins: int = 100) -> DataFrame:
    """``(series, bin, bin_start, n)`` of both class probabilities over their common range; empty bins left out.

    Bins are half-open, the last one closed.
    """
    counts = stage_table(
        scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("p")).agg(F.count("*").alias("n")),
        "score-values",
    )
    p = F.col("p")
    both = F.array(
        F.struct(F.lit("False").alias("series"), (F.lit(1.0) - p).alias("v"), "n"),
        F.struct(F.lit("True").alias("series"), p.alias("v"), "n"),
    )
    low, high = F.least(F.min(p), F.lit(1.0) - F.max(p)), F.greatest(F.max(p), F.lit(1.0) - F.min(p))
    # A single value gets a range of width 1 around it.
    margin = F.when(low == high, 0.5).otherwise(0.0)
    limits = counts.agg((low - margin).alias("lo"), (high + margin).alias("hi"))
    ranged = counts.select(F.inline(both)).withColumns(
        {"lo": limits.select("lo").scalar(), "hi": limits.select("hi").scalar()}
    )
    width = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    edge = lambda i: F.col("lo") + i * width
    # The division may land one bin off; the edges decide.
    index = F.when(F.col("v") < edge(F.col("b")), F.col("b") - 1).when(
        (F.col("v") >= edge(F.col("b") + 1)) & (F.col("b") < bins - 1), F.col("b") + 1
    ).otherwise(F.col("b"))
    binned = ranged.withColumn("b", guess).select("series", index.alias("bin"), edge(index).alias("bin_start"), "n")
    return binned.groupBy("series", "bin", "bin_start").agg(F.sum("n").alias("n"))


def bootstrap_draws(
    scored: DataFrame, key: str, draws: int, share: float, seed: int, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """``draws`` samples of ``share`` of the rows with replacement, as ``(draw, y, score)``.

    Position ``pos`` of a draw takes the row whose number is a hash of (seed, draw, pos) modulo the row count.
    """
    n = scored.count()
    size = int(n * share)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("pos").cast("string")))
    picks = (
        scored.sparkSession.range(draws * size)
        .select((F.floor(F.col("id") / size)).cast("int").alias("draw"), (F.col("id") % size).alias("pos"))
        .select("draw", (hash_number(digest) % n).alias("row_no"))
    )
    return picks.join(numbered(scored, key, n, piece_rows), "row_no").drop("row_no")


def interpolated(points: DataFrame, x: str, y: str, grid_points: int, origin: tuple[float, float]) -> DataFrame:
    """Linear interpolation of each draw's curve on an even grid over [0, 1].

    ``points`` holds ``(draw, score, x, y)`` and x never decreases as the score falls.  Each point belongs to
    the cell of the grid value at or above it; per cell only its first and last point are kept, so at most
    ``grid_points`` rows per draw are ordered.  At equal x the last point wins.
    """
    last_index = grid_points - 1
    step = 1.0 / last_index
    grid_value = lambda i: F.when(i == last_index, F.lit(1.0)).otherwise(i * F.lit(step))
    guess = F.ceil(F.col(x) * last_index).cast("int")
    cell = (
        F.when((F.col("_g") > 0) & (F.col(x) <= grid_value(F.col("_g") - 1)), F.col("_g") - 1)
        .when(F.col(x) > grid_value(F.col("_g")), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    celled = points.withColumn("_g", guess).withColumn("_cell", cell)
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = celled.groupBy("draw", "_cell").agg(
        F.max_by(point, "score").alias("_first"), F.min_by(point, "score").alias("_last")
    )
    grid = points.select("draw").distinct().withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.lit(last_index)))
    )
    # Bounded by draws x grid points.
    by_draw = Window.partitionBy("draw").orderBy("_cell")
    start = F.struct(F.lit(origin[0]).alias("x"), F.lit(origin[1]).alias("y"))
    around = grid.join(ends, ["draw", "_cell"], "left").select(
        "draw", "_cell",
        F.coalesce(F.last("_last", True).over(by_draw.rowsBetween(Window.unboundedPreceding, 0)), start).alias("_at"),
        F.first("_first", True).over(by_draw.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    g = grid_value(F.col("_cell"))
    slope = (F.col("_next.y") - F.col("_at.y")) / (F.col("_next.x") - F.col("_at.x"))
    value = F.when(F.col("_next").isNull() | (g == F.col("_at.x")), F.col("_at.y")).otherwise(
        F.col("_at.y") + slope * (g - F.col("_at.x"))
    )
    return around.select("draw", F.col("_cell").alias("grid_index"), g.alias("grid"), value.alias("value"))


def bootstrap_bands(
    scored: DataFrame,
    key: str,
    y: str = "y",
    score: str = "score",
    draws: int = BOOTSTRAP_DRAWS,
    share: float = BOOTSTRAP_SHARE,
    grid_points: int = CURVE_GRID_POINTS,
    seed: int = 0,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Mean curve and one-deviation band of ROC and PR over bootstrap draws: ``(curve, grid_index, grid, …)``.

    A draw without a positive or a negative row has no defined rates on that side and is left out of the mean.
    """
    rows = stage_table(scored.select(key, y, score), "scored")
    sample = bootstrap_draws(rows, key, draws, share, seed, piece_rows)
    counted = curve_counts(score_counts(sample, y, score, ["draw"]), ["draw"], piece_rows)
    roc = counted.where("n_neg > 0 AND n_pos > 0").select(
        "draw", "score", (F.col("fp") / F.col("n_neg")).alias("x"), (F.col("tp") / F.col("n_pos")).alias("y")
    )
    pr = counted.select("draw", "score", _recall().alias("x"), _precision().alias("y"))
    roc_values = interpolated(roc, "x", "y", grid_points, (0.0, 0.0)).withColumn(
        "value", F.when(F.col("grid_index") == 0, 0.0).otherwise(F.col("value"))
    )
    pr_values = interpolated(pr, "x", "y", grid_points, (0.0, 1.0))
    return _bands(roc_values, "roc").unionByName(_bands(pr_values, "pr"))


def _bands(values: DataFrame, curve: str) -> DataFrame:
    mean, spread = F.col("mean"), F.col("deviation")
    return (
        values.groupBy("grid_index", "grid")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
        .select(
            F.lit(curve).alias("curve"), "grid_index", "grid", "mean", "deviation",
            F.greatest(mean - spread, F.lit(0.0)).alias("lower"), F.least(mean + spread, F.lit(1.0)).alias("upper"),
        )
    )
