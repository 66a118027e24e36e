"""Inputs derived from the test tables, and the registered queries with their SQL twins."""

from . import evaluation, learned, series, streams, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "learned", "series", "streams", "tables"]
