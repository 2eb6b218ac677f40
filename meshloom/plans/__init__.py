"""Named queries over the derived fixtures, each with the SQL that answers it independently where there is any."""

from .registry import ORACLES, QUERIES, entry

__all__ = ["ORACLES", "QUERIES", "entry"]
