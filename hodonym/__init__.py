"""Hodonym: registry-of-names analytics for PySpark (deduplication, matching, consolidation, profiles)."""

__version__ = "0.1.0"
