"""Whole workflows: features, training, tuning and scoring."""
