"""Importing the query modules fills the registry."""

from . import correction, exchange, feeds, quality, reconcile, scoring, waveforms, windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
