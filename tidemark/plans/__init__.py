"""The engine's queries, by name, with the SQL that checks them."""

from . import fits, ingest, landed, long, moving, point, spread, times
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fits", "ingest", "landed", "long", "moving", "point", "spread", "times"]
