"""Named queries over the driver tables, with the SQL that they are held against."""

from . import core, network, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
