"""Incident hot spots on Spark: match, cluster, age and report, batch or stream."""

from roadpulse.params import CrispParams, FuzzyParams

__all__ = ["CrispParams", "FuzzyParams"]
