"""All registered queries of the drainage engine and their SQL."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

FLAGSHIP = "delineate_area"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
