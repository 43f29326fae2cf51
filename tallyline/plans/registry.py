"""Imports every module that registers core queries."""

from tallyline.plans import core_queries, skew_queries, source_queries  # noqa: F401

FLAGSHIP = "detect_pairs"
