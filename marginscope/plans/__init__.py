"""Named query plans: the Spark side (catalog) and the SQL oracle side."""

from .catalog import QUERIES, REPORTS, base
from .oracle import ORACLE

__all__ = ["QUERIES", "REPORTS", "ORACLE", "base"]
