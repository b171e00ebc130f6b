"""Every query of the library, by name."""

from . import basics, days, features, learning, markets, prediction, records, similarity
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "days", "features", "learning", "markets", "prediction", "records", "similarity"]
