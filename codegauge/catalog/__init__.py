"""Every query with its SQL twin; importing the parts fills the two dictionaries."""

from codegauge.catalog import graph, past, text, tree  # noqa: F401
from codegauge.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
