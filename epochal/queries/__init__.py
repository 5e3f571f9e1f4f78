"""One query for each operator, over the driver's tables."""

from . import columns, describing, further, histories, networks, structures
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "columns", "describing", "further", "histories", "networks", "structures"]
