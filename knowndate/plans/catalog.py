"""Imports every query module, so that the registry is complete."""

from knowndate.plans import (  # noqa: F401
    cohort_queries,
    evaluation_queries,
    identity_queries,
    model_queries,
    source_queries,
)
from knowndate.plans.registry import ORACLES, QUERIES  # noqa: F401
