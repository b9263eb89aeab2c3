"""name -> query and name -> SQL for all operators outside the optional subpackage."""

from __future__ import annotations

from apportion.plans import genome, quantify, records, statistics
from apportion.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "genome", "quantify", "records", "statistics"]
