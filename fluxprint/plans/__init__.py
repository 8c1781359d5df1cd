"""Queries over the driver's tables, grouped by subject."""

from fluxprint.plans import assessment, behaviour, devices, policies, sources, streams  # noqa: F401
from fluxprint.plans.registry import ORACLES, QUERIES  # noqa: F401
