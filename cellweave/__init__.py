"""Contextual features of gridded imagery, on Spark."""

from cellweave.spec import FeatureSpec, SpecError

__all__ = ["FeatureSpec", "SpecError"]
