import random

import numpy as np
import pytest

from clinspark.operators import metrics


def scored(spark, pairs):
    return spark.createDataFrame([(i, int(y), float(p)) for i, (y, p) in enumerate(pairs)], "row_id bigint, y int, score double")


FOUR = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    pairs = [(int(rng.random() < 0.4), round(rng.random(), 3)) for _ in range(3000)]
    return pairs, scored(spark, pairs).repartition(6).cache()


def brute_curve(pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] for p in pairs])
    cuts = np.unique(s)[::-1]
    tp = np.array([((s >= c) & (y == 1)).sum() for c in cuts])
    fp = np.array([((s >= c) & (y == 0)).sum() for c in cuts])
    return cuts, tp, fp, (y == 1).sum(), (y == 0).sum()


def test_known_values(spark):
    df = scored(spark, FOUR)
    assert metrics.average_precision(df).first().ap == pytest.approx(0.8333333)
    assert metrics.recall_at_precision(df).first().recall == 0.5
    assert metrics.recall_at_precision(scored(spark, [(1, 0.1), (0, 0.9)])).first().recall == 0


@pytest.mark.parametrize("piece", [37, 10**6])
def test_curves(many, piece):
    pairs, df = many
    cuts, tp, fp, n_pos, n_neg = brute_curve(pairs)
    pr = {r.threshold: (r.precision, r.recall) for r in metrics.pr_points(df, piece_rows=piece).collect()}
    roc = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_points(df, piece_rows=piece).collect()}
    assert pr.pop(None) == (1.0, 0.0) and roc.pop(None) == (0.0, 0.0)
    for c, t, f in zip(cuts, tp, fp):
        assert pr[c] == pytest.approx((t / (t + f), t / n_pos))
        assert roc[c] == pytest.approx((f / n_neg, t / n_pos))
    ap = metrics.average_precision(df, piece_rows=piece).first().ap
    assert ap == pytest.approx(float(np.sum(np.diff(np.r_[0, tp]) / n_pos * tp / (tp + fp))))


def test_report_rows(many):
    _, df = many
    report = {r.metric: r.value for r in metrics.metric_report(df, "val").collect()}
    assert set(report) == {"acc", "balanced_acc", "f1_score", "PR80", "ap"}
    assert all(0 <= v <= 1 for v in report.values())


def test_confusion_has_all_cells(spark):
    got = [tuple(r) for r in metrics.confusion(scored(spark, [(1, 0.9), (1, 0.5)])).orderBy("y", "predicted").collect()]
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)]


def test_calibration_edges(spark):
    got = {r.bin: r.n for r in metrics.calibration_bins(scored(spark, [(0, 0.0), (1, 0.1), (0, 0.1000001), (1, 1.0)])).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_histogram(many):
    pairs, df = many
    p = np.array([s for _, s in pairs])
    lo, hi = min(p.min(), (1 - p).min()), max(p.max(), (1 - p).max())
    got = metrics.score_histogram(df).collect()
    for series, values in (("True", p), ("False", 1 - p)):
        want, _ = np.histogram(values, bins=100, range=(lo, hi))
        have = np.zeros(100, int)
        for r in got:
            if r.series == series:
                have[r.bin] = r.n
        assert have.sum() == len(values) and np.abs(np.cumsum(have) - np.cumsum(want)).max() <= 12


def test_histogram_of_one_value(spark):
    got = metrics.score_histogram(scored(spark, [(1, 0.5), (0, 0.5)])).collect()
    assert sorted((r.series, r.bin, r.n) for r in got) == [("False", 50, 2), ("True", 50, 2)]


@pytest.mark.parametrize("piece", [200, 10**6])
def test_bands_against_numpy(many, piece):
    _, df = many
    draws = metrics.bootstrap_draws(df.select("row_id", "y", "score"), "row_id", 4, 0.2, 9, piece).collect()
    roc, pr, grid = [], [], np.linspace(0, 1, 50)
    for d in range(4):
        sample = [(r.y, r.score) for r in draws if r.draw == d]
        assert len(sample) == 600
        _, tp, fp, n_pos, n_neg = brute_curve(sample)
        curve = np.interp(grid, np.r_[0, fp / n_neg], np.r_[0, tp / n_pos])
        curve[0] = 0
        roc.append(curve)
        pr.append(np.interp(grid, np.r_[0, tp / n_pos], np.r_[1, tp / (tp + fp)]))
    bands = metrics.bootstrap_bands(df, "row_id", draws=4, grid_points=50, seed=9, piece_rows=piece).collect()
    for name, curves in (("roc", roc), ("pr", pr)):
        got = sorted((r for r in bands if r.curve == name), key=lambda r: r.grid_index)
        assert [r["mean"] for r in got] == pytest.approx(np.mean(curves, axis=0).tolist())
        assert [r.deviation for r in got] == pytest.approx(np.std(curves, axis=0).tolist(), abs=1e-12)
        assert all(0 <= r.lower <= r.upper <= 1 for r in got)
