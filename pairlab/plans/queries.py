"""Imports every query module so the registry is complete."""

from pairlab.plans import q_augment, q_evaluate, q_jobs, q_prepare, q_retrieve, q_runs  # noqa: F401
from pairlab.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
