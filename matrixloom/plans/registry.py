"""Registered queries of the score-matrix engine and the SQL that says what each returns."""

from __future__ import annotations

from . import blocks, completion, further, inference, matrices, preparation, sensitivity, wider  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

FLAGSHIP = "g03_participation"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
