"""All registered queries."""

from barloom.plans import bars_features, ingest, market, modeling, sinks, trading  # noqa: F401
from barloom.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
