"""Scans, typed loads, sinks and the derived test views."""

from ledgerlens.sources.tables import read_table

__all__ = ["read_table"]
