"""The query catalogue: every registered query and its oracle SQL."""

from __future__ import annotations

from runlens.plans import q_built, q_io, q_misc, q_runs, q_text  # noqa: F401  (registers queries)
from runlens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
