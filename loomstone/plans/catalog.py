"""All queries of the library over the given tables."""

from loomstone.plans import (  # noqa: F401
    analytics, complaints, extraction, gazetteers, geography, identities, matching, modelling, networks, outputs, publishing,
    qualities, readmodels, relational, steps, summaries, texts, visits,
)
from loomstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
