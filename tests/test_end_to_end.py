"""Train the three outcomes, save, load, and score unseen subjects."""

from clinspark.catalog import standins as s
from clinspark.catalog.queries import QUERIES

COLUMNS = ["mortality_proba", "prolonged_LOS_proba", "readmission_proba"]


def test_score_all_targets(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = QUERIES["score_all_targets"](spark, sf_dir)
    assert scored.columns == ["subject_id", *COLUMNS]
    rows = scored.collect()
    trained = {r.subject_id for r in s.event_cohort(spark, sf_dir).collect()}
    assert rows and len({r.subject_id for r in rows}) == len(rows)
    assert not trained & {r.subject_id for r in rows}
    for column in COLUMNS:
        values = [r[column] for r in rows if r[column] is not None]
        assert values and all(0 <= v <= 1 for v in values)
    # Extended features need score rows, so some subjects are only in the first cohort.
    assert any(r.prolonged_LOS_proba is None for r in rows)


def test_outcomes_share_one_aggregate(spark):
    """Features from the shared aggregate are those built alone, and the hourly table is not read again."""
    from clinspark.config import FINAL_MODELS
    from clinspark.plans.training import outcome_features, shared_stays

    sf_dir = "/root/testdata/sf0.001"
    study, cohort = s.study(spark, sf_dir), s.event_cohort(spark, sf_dir)
    stays = shared_stays(study, cohort, FINAL_MODELS)
    assert len(stays) == 1
    for config in FINAL_MODELS.values():
        shared, alone = (outcome_features(study, cohort, config, x) for x in (stays, None))
        assert shared.columns == alone.columns
        assert shared.exceptAll(alone).count() == 0 and alone.exceptAll(shared).count() == 0
