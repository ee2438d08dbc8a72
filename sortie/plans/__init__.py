"""Registered queries."""

from . import (  # noqa: F401
    q_coverage,
    q_curves,
    q_findings,
    q_logs,
    q_runs,
    q_samples,
    q_scalars,
    q_selectors,
    q_streaming,
)
from .registry import ENTRIES  # noqa: F401
