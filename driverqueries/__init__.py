"""Queries of the engine over the given tables, each with the SQL it must agree with."""

from driverqueries.registry import CHECKS, QUERIES  # noqa: F401
from driverqueries import series, typed, stores, read_side, streams, passes  # noqa: F401
