"""Queries: declared plans over the provided tables."""

from __future__ import annotations

from quillon.plans import datasets, extra, recommend, rollouts, scoring, streams
from quillon.plans.recommend import flagship

__all__ = ["datasets", "extra", "flagship", "recommend", "rollouts", "scoring", "streams"]
