"""Registered queries."""

from tipoff.plans import boards, checks, ingest, legacy, models, sports, upkeep, variants
from tipoff.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boards", "checks", "ingest", "legacy", "models", "sports", "upkeep", "variants"]
