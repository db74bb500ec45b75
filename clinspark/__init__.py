"""Clinical cohort selection, feature building and risk modelling on Spark DataFrames."""

from clinspark.plans.scoring import score_unseen_subjects
from clinspark.session import configure

__all__ = ["configure", "score_unseen_subjects"]
