"""Every query on the supplied tables, next to the SQL that must give the same rows."""

from sql_checks import candles, economy, landing, market, news, quality, risk, stored, streams  # noqa: F401
from sql_checks.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
