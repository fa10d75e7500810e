"""Readers of landed data."""

from quillspark.sources.tables import table

__all__ = ["table"]
